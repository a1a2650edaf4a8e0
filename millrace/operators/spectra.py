"""Spectral analytics of vectors read as square arrays: cosine modes, power, radial profiles, bands, log-spectral distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cosine_basis(spark: SparkSession, side: int) -> DataFrame:
    """(pos, i, j, b): the orthonormal two-dimensional cosine basis of a side x side array; side**4 rows, fixed by side."""
    at = spark.range(side * side).select((F.col("id") / side).cast("int").alias("y"), (F.col("id") % side).cast("int").alias("x"), F.col("id").cast("int").alias("pos"))
    ij = spark.range(side * side).select((F.col("id") / side).cast("int").alias("i"), (F.col("id") % side).cast("int").alias("j"))

    def wave(n: Column, x: Column) -> Column:
        scale = F.when(n == 0, math.sqrt(1 / side)).otherwise(math.sqrt(2 / side))
        return scale * F.cos(F.lit(math.pi) * (2 * x + 1) * n / (2 * side))

    return at.crossJoin(ij).select("pos", "i", "j", (wave(F.col("i"), F.col("y")) * wave(F.col("j"), F.col("x"))).alias("b"))


def mode_power(long: DataFrame, side: int, group: list[str]) -> DataFrame:
    """(group, i, j, power): the population variance of each mode over the rows (id, pos, x); the mean mode is 0.

    The basis is a fixed small table and is broadcast; rows are summed up by item and mode, then by mode."""
    basis = F.broadcast(cosine_basis(long.sparkSession, side))
    modes = long.join(basis, "pos").groupBy(*group, "id", "i", "j").agg(F.sum(F.col("x") * F.col("b")).alias("c"))
    power = F.when((F.col("i") == 0) & (F.col("j") == 0), 0.0).otherwise(F.var_pop("c"))
    return modes.groupBy(*group, "i", "j").agg(power.alias("power"))


def radius() -> Column:
    """Half the distance of a mode from the origin: cycles across the array."""
    return F.sqrt((F.col("i") * F.col("i") + F.col("j") * F.col("j")).cast("double")) / 2


def octave_bins(spark: SparkSession, n: int, low: float = 0.5) -> DataFrame:
    """(bin, lo, hi, is_last): n octaves from ``low`` on; half-open, the last one closed."""
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), (low * F.pow(F.lit(2.0), F.col("id"))).alias("lo"), (low * F.pow(F.lit(2.0), F.col("id") + 1)).alias("hi"), (F.col("id") == n - 1).alias("is_last"))


def binned(rows: DataFrame, bins: DataFrame, value: Column) -> DataFrame:
    """A left join of the bins with the rows whose value lies in them; there are a few dozen bins at most."""
    inside = (value >= F.col("lo")) & ((value < F.col("hi")) | (F.col("is_last") & (value == F.col("hi"))))
    return rows.join(F.broadcast(bins), inside)


def octave_shares(power: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin, share): the share of the binned power in each octave."""
    sums = binned(power, bins, radius()).groupBy("bin").agg(F.sum("power").alias("p"))
    filled = bins.select("bin").join(sums, "bin", "left").select("bin", F.coalesce("p", F.lit(0.0)).alias("p"))
    total = filled.agg(F.sum("p").alias("t"))
    return filled.crossJoin(total).select("bin", (F.col("p") / F.col("t")).alias("share"))  # one row of totals


def radial_profile(power: DataFrame, bins: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, bin, n_modes, mean_power): the mean power in each bin that holds a mode, but for the mean mode."""
    keys = [*(group or []), "bin"]
    return binned(power.filter("i + j > 0"), bins, radius()).groupBy(*keys).agg(F.count("*").alias("n_modes"), F.avg("power").alias("mean_power"))


def log_distance(one: DataFrame, two: DataFrame) -> DataFrame:
    """(n_bins, lsd): root mean square of the difference of log10 profiles over the bins where both have power."""
    a, b = one.select("bin", F.col("mean_power").alias("p")), two.select("bin", F.col("mean_power").alias("q"))
    both = a.join(b, "bin").filter("p > 0 and q > 0").select((F.log10("p") - F.log10("q")).alias("d"))
    return both.agg(F.count("*").alias("n_bins"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("lsd"))


def low_pass_share(power: DataFrame, side: int, sigma: float) -> DataFrame:
    """(share): the power that a heat kernel of width sigma leaves: sum p exp(-2 l t) / sum p, t = sigma**2 / 2."""
    lam = math.pi**2 * (F.col("i") * F.col("i") + F.col("j") * F.col("j")) / (side * side)
    return power.agg((F.sum(F.col("power") * F.exp(-lam * sigma * sigma)) / F.sum("power")).alias("share"))
