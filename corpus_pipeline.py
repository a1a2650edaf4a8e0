"""A training-corpus pipeline: each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import pipeline_stages as stages
from millrace.plans.lineage import release, temporary
from millrace.sources.tables import read_table

STAGES = [
    ("quality_rules", stages.quality),
    ("minhash_near_dedup", stages.near_duplicates),
    ("substring_dedup", stages.substrings),
    ("benchmark_decontamination", stages.benchmark_free),
    ("bpe_encoding", stages.encoded),
]

#: The model-based stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage was given is deleted when its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary(spark) as keep:
            docs = keep(stage(spark, before, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
