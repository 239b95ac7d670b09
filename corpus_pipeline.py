"""Corpus pipeline: quality rules, near copies, repeated passages, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, quality, simhash, substrings
from tidemark.session import materialize

STAGES = [
    ("quality", quality.keep_clean),
    ("near_copies", simhash.drop_copies),
    ("passages", substrings.drop_repeats),
    ("mixture", mixing.repeat_to_targets),
    ("tokens", bpe.encode_stage),
]

#: No SQL expresses near-copy groups, repeated passages, the fitted mixture or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
