"""The pipeline over documents: each stage works on all that the one before it kept.

Defined results: a null text is empty and fails the quality rules; a null doc_id is an id like
others, smallest for exact duplicates and last elsewhere; of rows that repeat one stays; a
document whose words are all repeats goes; an empty table gives an empty table; columns beyond
those of documents are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpline.llm.common import table, written
from kelpline.llm.exact_dedup import exact_stage
from kelpline.llm.near_dedup import near_stage
from kelpline.llm.packing import packing_stage
from kelpline.llm.quality_rules import quality_stage
from kelpline.llm.substrings import substring_stage

#: In order; all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]
#: Near duplicates, chains and packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
