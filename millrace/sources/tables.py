"""Readers for the Parquet tables the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read through Spark (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
