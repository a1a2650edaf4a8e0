"""Closed forms of how much a sample's variance owes to its seed, and synthetic spectra. Anything that is missing gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def within_fraction(diversity: Column, side: int, power: Column) -> Column:
    """The variance within seeds over that of the population: ``diversity`` is per mode but the mean, ``power`` the sum over them."""
    return F.when(power > 0, diversity * (side * side - 1) / power)


def within_share(diversity: Column, per_seed: Column, side: int, power: Column) -> Column:
    """What is left to the seed, with the variance of ``per_seed`` samples corrected for their own mean; null for fewer than two."""
    return F.when(per_seed >= 2, 1 - per_seed / (per_seed - 1) * within_fraction(diversity, side, power))


def bias_fraction(measured: Column, diversity: Column, side: int, power: Column) -> Column:
    """What neither the measured share nor the variance within seeds accounts for."""
    return 1 - measured - within_fraction(diversity, side, power)


def bias_expected(predicted: Column, mean_term: Column, per_seed: Column) -> Column:
    """What the bias fraction comes to if the prediction holds."""
    return F.when(per_seed >= 1, mean_term + (1 - predicted) / per_seed)


def regeneration(within: Column, predicted: Column) -> Column:
    """The variance that samples add over what was taken away; null where nothing was."""
    return F.when(predicted < 1, (1 - within) / (1 - predicted))


def power_law(spark: SparkSession, side: int, alpha: float, total: float) -> DataFrame:
    """(i, j, power): a spectrum that falls with the radius to the power -alpha and adds up to ``total``; the mean mode has none."""
    at = spark.range(side * side).select((F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))
    radius = F.sqrt((F.col("i") * F.col("i") + F.col("j") * F.col("j")).cast("double"))
    raw = at.withColumn("raw", F.when(radius > 0, F.pow(radius, F.lit(-alpha))).otherwise(0.0))
    sums = raw.agg(F.sum("raw").alias("all"))
    return raw.crossJoin(sums).select("i", "j", (F.col("raw") * total / F.col("all")).alias("power"))  # one row of sums


def grid(spark: SparkSession, side: int, bins: int = 48, scaled_from: int = 128, fixed: float = 96.0) -> DataFrame:
    """(bin, lo, hi, is_last): logarithmic bins from half a cycle to side / 2 cycles; for arrays narrower than
    ``scaled_from`` up to ``fixed`` cycles whatever the side, so that bins without a mode stay empty."""
    if side < 2 or bins < 2:
        raise ValueError(f"at least 2 x 2 values and 2 bins, not {side} and {bins}")
    most = side / 2 if side >= scaled_from else fixed
    edge = lambda k: F.lit(0.5) * F.pow(F.lit(2 * most), k / bins)
    k = F.col("id")
    return spark.range(bins).select(k.cast("int").alias("bin"), edge(k).alias("lo"), edge(k + 1).alias("hi"), (k == bins - 1).alias("is_last"))
