import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from kelpline.llm import packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string"


def test_pipeline_against_what_each_stage_should_leave(spark, tmp_path):
    rng = random.Random(21)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, three, shared = fresh(120), fresh(200), fresh(90), fresh(70)
    near = two.split()
    near[50] = "changed"
    head, foot = fresh(60), fresh(60)
    rows = [
        (1, one), (2, one.upper().replace("W", "w")),  # of equal texts, the one with the largest id stays
        (3, two), (4, " ".join(near)),  # of near copies, the one with the smallest
        (5, f"{fresh(80)} {shared} {fresh(80)}"), (6, f"{head} {shared} {foot}"),  # the second loses the passage
        (7, three), (7, three),  # one of rows that repeat
        (8, fresh(20)), (9, "again and " * 80), (10, None), (11, ""), (None, None),  # these fail the base rules
        (None, fresh(70)),
    ]
    left = {2: rows[1][1], 3: two, 5: rows[4][1], 6: f"{head}  {foot}", 7: three, None: rows[-1][1]}
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), t) for k, (i, t) in enumerate(rows)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    real = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert set(pieces) == set(left)
    for i, text in left.items():
        n = len(real.encode(text, add_special_tokens=False).ids) + 1
        assert {p[2] for p in pieces[i]} == {n} and sum(p[1] for p in pieces[i]) == n
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
