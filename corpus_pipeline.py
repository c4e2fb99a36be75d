"""The corpus pipeline: stages that each take what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import stages
from quillgraph.llm.common import materialize, table

#: In order: language ID, MinHash near-dedup, suffix-array dedup, benchmark decontamination, mixing to weights.
STAGES = [
    ("language", stages.language),
    ("near_duplicates", stages.near_duplicates),
    ("repeats", stages.repeats),
    ("benchmark_leaks", stages.benchmark_leaks),
    ("mixture", stages.mixture),
]

#: Compressors, sketches and suffix arrays are not SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
