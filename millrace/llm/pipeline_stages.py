"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents that stay.

Every stage works on whatever its predecessor kept and returns the columns of its input, the last one
excepted: it puts ids, n_tokens and decoded_sha256 in the place of the text, and input columns of these names give way to them.
Columns that a stage adds on the way have names that end in two underscores.

Edge cases: null, empty and short texts fail the quality rules' base and go; rows without an id stay or go by their own text, and are no
reference for others' passages; of rows with one id and one text, which are one document, all stay or all go; an empty
table gives an empty table; other columns, whatever their names, are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import read_table

from . import bpe_automaton, decontaminate, minhash_dedup, quality_rules, substring_dedup
from .keys import small_batches
from .queries import VOCABULARY


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` but for those named by doc_id and text_hash in ``dropped``."""
    dropped = dropped.select(F.col("doc_id").alias("doc_id__"), F.col("text_hash").alias("text_hash__"))
    named = F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash__")
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("doc_id__")) & named, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    marked = quality_rules.score(docs.withColumnRenamed("quality", "input_quality__"))
    return marked.filter(F.col("quality.kept")).drop("quality").withColumnRenamed("input_quality__", "quality").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    return _without(docs, found.filter("not kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are taken out of the texts; n_chars follows."""
    out = substring_dedup.strip(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with the benchmark's items go."""
    found = decontaminate.report(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of what they decode to, in place of the text."""
    vocabulary = bpe_automaton.read_vocabulary(spark, VOCABULARY)
    rest = [c for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded_sha256")]
    out = small_batches(docs).select(*rest, bpe_automaton.encoded(F.col("text"), vocabulary).alias("encoded__"))
    return out.select(*rest, F.size("encoded__.ids").cast("bigint").alias("n_tokens"), "encoded__.ids", "encoded__.decoded_sha256")
