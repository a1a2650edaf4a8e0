"""Curves of values by step, one for each group: smoothing, first crossing, settling, plateau, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_mean(curves: DataFrame, group: str, window: int) -> DataFrame:
    """Trailing mean; the head of a curve is averaged over what there is (smooth), or a curve shorter than
    the window is left as it is (smooth_or_raw)."""
    w = Window.partitionBy(group).orderBy("step")
    mean = F.avg("v").over(w.rowsBetween(1 - window, 0))
    size = F.count("*").over(Window.partitionBy(group))
    return curves.select("*", mean.alias("smooth"), F.when(size < window, F.col("v")).otherwise(mean).alias("smooth_or_raw"))


def first_crossing(curves: DataFrame, group: str, threshold: Column) -> DataFrame:
    """(group, first_step): the first step with a value at most the threshold; null if there is none."""
    return curves.groupBy(group).agg(F.min(F.when(F.col("v") <= threshold, F.col("step"))).alias("first_step"))


def settling_step(curves: DataFrame, group: str, threshold: Column) -> DataFrame:
    """(group, settle_step): where the final run of values at most the threshold starts; null if the last is above."""
    above = curves.groupBy(group).agg(F.max(F.when(F.col("v") > threshold, F.col("step"))).alias("last_above"))
    after = F.when(F.col("last_above").isNull() | (F.col("step") > F.col("last_above")), F.col("step"))
    return curves.join(above, group).groupBy(group).agg(F.min(after).alias("settle_step"))


def plateau_step(curves: DataFrame, group: str, tolerance: float, final: int) -> DataFrame:
    """(group, plateau, final_mean): the first step after the last that is further than ``tolerance`` from the
    mean of the steps within ``final`` of the end; the last step if that one is off itself."""
    ends = curves.groupBy(group).agg(F.max("step").alias("end"))
    placed = curves.join(ends, group)
    means = placed.filter(F.col("step") > F.col("end") - final).groupBy(group).agg(F.avg("v").alias("final_mean"))
    placed = placed.join(means, group)
    off = placed.groupBy(group, "end", "final_mean").agg(F.max(F.when(F.abs(F.col("v") - F.col("final_mean")) > tolerance, F.col("step"))).alias("off"))
    after = F.when(F.col("off").isNull() | (F.col("step") > F.col("off")), F.col("step"))
    return placed.join(off.select(group, "off"), group).groupBy(group).agg(F.coalesce(F.min(after), F.max("end")).alias("plateau"), F.max("final_mean").alias("final_mean"))


def peak(curves: DataFrame, group: str) -> DataFrame:
    """(group, first_v, peak_step, peak_v, last_v); of equal peaks the first."""
    best = F.max(F.struct(F.col("v"), (-F.col("step")).alias("s")))
    return curves.groupBy(group).agg(F.min(F.struct("step", "v"))["v"].alias("first_v"), (-best["s"]).alias("peak_step"), best["v"].alias("peak_v"), F.max(F.struct("step", "v"))["v"].alias("last_v"))


def streaks(log: DataFrame, group: str, order: str, failed: Column) -> DataFrame:
    """(group, n_failed, longest): failures, and the longest run of them in a row."""
    w = Window.partitionBy(group).orderBy(order)
    v = Window.partitionBy(group, "bad").orderBy(order)
    marked = log.withColumn("bad", failed).withColumn("all_", F.row_number().over(w)).withColumn("own", F.row_number().over(v))
    runs = marked.groupBy(group, "bad", (F.col("all_") - F.col("own")).alias("island")).agg(F.count("*").alias("k"))
    return runs.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("bad"), F.col("k"))), F.lit(0)).alias("n_failed"), F.coalesce(F.max(F.when(F.col("bad"), F.col("k"))), F.lit(0)).alias("longest"))


def abort_points(log: DataFrame, group: str, order: str, failed: Column, most_in_a_row: int, most: int) -> DataFrame:
    """(group, order, n_failed, in_a_row, reason): for each group whose failures reach ``most_in_a_row`` in a row or exceed ``most`` in
    all, the event that does so first, with the counts there; a run in a row is told first."""
    w = Window.partitionBy(group).orderBy(order)
    bad = F.coalesce(failed, F.lit(False)).cast("int")
    marked = log.select(group, order, bad.alias("bad")).withColumn("n_failed", F.sum("bad").over(w)).withColumn("at", F.row_number().over(w))
    good = F.coalesce(F.max(F.when(F.col("bad") == 0, F.col("at"))).over(w), F.lit(0))
    marked = marked.withColumn("in_a_row", (F.col("at") - good).cast("bigint"))
    reason = F.when(F.col("in_a_row") >= most_in_a_row, F.concat("in_a_row", F.lit(" failures in a row")))
    reason = reason.when(F.col("n_failed") > most, F.concat("n_failed", F.lit(" failures")))
    stops = marked.filter("bad = 1").withColumn("reason", reason).filter("reason is not null")
    first = stops.groupBy(group).agg(F.min(F.struct(order, "n_failed", "in_a_row", "reason")).alias("x"))
    return first.select(group, "x.*")


def increasing(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, n, n_falls): consecutive differences that are not positive."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("d", step).groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("d") <= 0).alias("n_falls"))


def reaches_share(rows: DataFrame, group: str, order: str, value: str, share: float) -> DataFrame:
    """(group, k): the first position at which the running sum reaches ``share`` of the total."""
    w = Window.partitionBy(group).orderBy(F.desc(value), order)
    total = F.sum(value).over(Window.partitionBy(group))
    placed = rows.select(group, F.row_number().over(w).alias("k"), (F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("part"))
    return placed.filter(F.col("part") >= share - 1e-12).groupBy(group).agg(F.min("k").alias("k"))
