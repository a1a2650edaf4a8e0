"""Ordered event logs: count windows, rewinds, cadence, per-kind rules, majority and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_windows(log: DataFrame, step: str, every: int) -> DataFrame:
    """The rows with ``window``: closed on each multiple of ``every``; step 0 is a window of its own."""
    return log.withColumn("window", F.ceil(F.col(step) / every))


def rewound(log: DataFrame, group: str, order: str, kind: Column, step: Column) -> DataFrame:
    """The rows that stand after rewinds: a resume at step r drops every earlier row with a step of r or
    more; rows without a step stay. A resume counts even if a later one drops it."""
    back = F.min(F.when(kind, step)).over(Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing))
    return log.withColumn("back", back).filter(F.col("back").isNull() | (F.coalesce(step, F.lit(-1)) < F.col("back"))).drop("back")


def cadence(rows: DataFrame, group: str, step: str, every: int = 1) -> DataFrame:
    """(group, n_missing, n_extra): steps 0, every, .. up to the last that are missing, and others that are there."""
    have = rows.select(group, F.col(step).cast("bigint").alias("s")).distinct()
    want = have.groupBy(group).agg(F.max("s").alias("m")).select(group, F.explode(F.sequence(F.lit(0).cast("bigint"), "m", F.lit(every).cast("bigint"))).alias("s"))
    both = have.withColumn("have", F.lit(1)).join(want.withColumn("want", F.lit(1)), [group, "s"], "full_outer")
    return both.groupBy(group).agg(F.count_if(F.col("have").isNull()).alias("n_missing"), F.count_if(F.col("want").isNull()).alias("n_extra"))


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, modal, n, n_drift): the most frequent value (ties by value), and how many rows differ."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("k"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("k"), value)))
    return ranked.groupBy(group).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("modal"), F.sum("k").alias("n"), F.sum(F.when(F.col("r") > 1, F.col("k")).otherwise(0)).alias("n_drift"))


def key_violations(documents: Column, expected: list[str]) -> Column:
    """The names missing from or foreign to a JSON object, sorted."""
    keys = F.json_object_keys(documents)
    want = F.array(*map(F.lit, expected))
    return F.array_sort(F.concat(F.array_except(want, keys), F.array_except(keys, want)))
