"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import alignment, bpe, exact_dedup, lm_scoring, near_dedup, packing, quality_rules, substrings, suffix_dedup, toxicity, url_filters, warc, whitening

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_url_filters": url_filters.op3_url_filters,
    "op4_warc": warc.op4_warc,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_packing": packing.op8_packing,
    "op9_substring_dedup": substrings.op9_substring_dedup,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}
SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_url_filters": url_filters.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
