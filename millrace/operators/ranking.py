"""Row numbers and exact quantiles over whole tables, by range partitions: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import stash


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with i (0, 1, .. in each group, by ``order``) and n (the group's size).

    The rows are range-partitioned by group and order; a partition's rows are numbered in their own task, after as many
    as the partitions before it hold. Nulls come first. ``order`` should tell all rows of a group apart.
    """
    placed = stash(rows.repartitionByRange(*group, *order).withColumn("part__", F.spark_partition_id()), "placed")
    counts = placed.groupBy(*group, "part__").agg(F.count("*").alias("k__"))  # a row for each partition and group in it
    whole = Window.partitionBy(*group)
    before = counts.select(*group, "part__", (F.sum("k__").over(whole.orderBy("part__")) - F.col("k__")).alias("before__"), F.sum("k__").over(whole).alias("n"))
    same = F.lit(True)
    for g in group:
        same = same & placed[g].eqNullSafe(before[g])
    joined = placed.join(before, (placed["part__"] == before["part__"]) & same).drop(before["part__"], *(before[g] for g in group))
    own = F.row_number().over(Window.partitionBy(*group, "part__").orderBy(*order)) - 1
    return joined.withColumn("i", own + F.col("before__")).drop("part__", "before__")


def quantiles(rows: DataFrame, group: list[str], value: Column, at: dict[str, float]) -> DataFrame:
    """(group, one column for each of ``at``): exact quantiles of the values that aren't null, with linear interpolation."""
    ranked = numbered(rows.select(*group, value.cast("double").alias("v__")).filter("v__ is not null"), group, ["v__"])
    out = []
    for name, q in at.items():
        place = q * (F.col("n") - 1)
        low, high = (F.max(F.when(F.col("i") == f(place), F.col("v__"))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*group).agg(*out)
