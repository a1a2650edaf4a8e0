"""Experiment tables: designed against observed cells, contrasts, decomposition, transfer, reconciliation, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import contrast


def design_status(design: DataFrame, observed: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Every designed cell with present, n and its group's status (``complete`` or ``incomplete: k/n``)."""
    joined = design.join(observed, keys, "left").withColumn("present", F.col("n").isNotNull())
    w = Window.partitionBy(group)
    k, n = F.count_if("present").over(w), F.count("*").over(w)
    status = F.when(k == n, "complete").otherwise(F.concat(F.lit("incomplete: "), k.cast("string"), F.lit("/"), n.cast("string")))
    return joined.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "present", status.alias("status"))


def contrasts(cells: DataFrame, arm: str, unit: str, baseline: str, n_boot: int, required: int) -> DataFrame:
    """(arm, n, mean_delta, ci_low, ci_high, excludes_zero, status): each arm against the baseline, paired by unit."""
    base = cells.filter(F.col(arm) == baseline).select(unit, F.col("value").alias("b"))
    deltas = cells.filter(F.col(arm) != baseline).join(base, unit).select(arm, unit, (F.col("value") - F.col("b")).alias("delta"))
    out = contrast(deltas, [arm], unit, n_boot)
    status = F.when(F.col("n") < required, F.concat(F.lit("incomplete: "), F.col("n").cast("string"), F.lit("/"), F.lit(str(required)))).when(~F.col("excludes_zero"), "not detectable").otherwise("ok")
    return out.withColumn("status", status)


def decomposition(parts: DataFrame, part: str, unit: str) -> DataFrame:
    """(part, n, delta, share): mean change of each part on the units that all parts share, and its share of the total."""
    k = parts.select(part).distinct().count()
    common = parts.groupBy(unit).agg(F.count_distinct(part).alias("k")).filter(F.col("k") == k).select(unit)
    means = parts.join(common, unit).groupBy(part).agg(F.count("*").alias("n"), F.avg("delta").alias("delta"))
    return means.withColumn("share", F.try_divide("delta", F.sum("delta").over(Window.partitionBy())))


def transfer(effects: DataFrame, group: str, endpoint: str, value: str) -> DataFrame:
    """(group_a, group_b, n, agree): how often the signs of two groups' effects on an endpoint agree."""
    a = effects.select(F.col(group).alias("group_a"), endpoint, F.signum(value).alias("sa"))
    b = effects.select(F.col(group).alias("group_b"), endpoint, F.signum(value).alias("sb"))
    both = a.join(b, endpoint).filter("group_a < group_b")
    return both.groupBy("group_a", "group_b").agg(F.count("*").alias("n"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("agree"))


def zero_filled_histogram(rows: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """(v, n, share) for every integer from low to high."""
    counts = rows.select(value.cast("int").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("v"))
    filled = grid.join(counts, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"))
    total = filled.agg(F.sum("n").alias("t"))
    return filled.crossJoin(total).select("v", "n", (F.col("n") / F.col("t")).alias("share"))  # one row


def reconcile(wide: DataFrame, long: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(metric, n, n_missing, n_differ): a wide table against a long one (key, metric, value)."""
    names = [c for c in wide.columns if c != key]
    tall = wide.unpivot([key], names, "metric", "w")
    both = tall.join(long.select(key, "metric", F.col("value").alias("l")), [key, "metric"], "full_outer")
    close = F.abs(F.col("w") - F.col("l")) <= tolerance * F.greatest(F.abs("w"), F.abs("l"))
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(F.col("w").isNull() | F.col("l").isNull()).alias("n_missing"), F.count_if(~close).alias("n_differ"))
