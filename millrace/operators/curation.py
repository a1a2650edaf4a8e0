"""Exact dedup, accept-first-n, entity and stratified splits, gates and integrity rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.draws import draw

from .ranking import numbered, quantiles


def exact_dedup(rows: DataFrame, order: str, content: Column) -> DataFrame:
    """Each row's order column, first_idx (the first row with the same content) and kept.

    Grouped by digest and joined back, so that a group of copies of any size is aggregated in parts."""
    marked = rows.select(order, F.sha2(content, 256).alias("digest"))
    first = marked.groupBy("digest").agg(F.min(order).alias("first_idx"))
    return marked.join(first, "digest").select(order, "first_idx", (F.col(order) == F.col("first_idx")).alias("kept"))


def rejections(rows: DataFrame, group: str, reason: Column) -> DataFrame:
    """(group, reason, n, scanned): counts by reason of rejection, ok for what passes."""
    told = rows.select(group, reason.alias("reason")).groupBy(group, "reason").agg(F.count("*").alias("n"))
    return told.withColumn("scanned", F.sum("n").over(Window.partitionBy(group)))


def accept_first(rows: DataFrame, order: str, ok: Column, content: Column, n: int) -> DataFrame:
    """The first n rows, in order, that pass and whose content is new among those that pass."""
    passed = rows.filter(ok)
    kept = exact_dedup(passed, order, content).filter("kept")
    return kept.select(order).orderBy(order).limit(n)


def accept_until(rows: DataFrame, order: str, ok: Column, content: Column, n: int, doublings: int = 6) -> DataFrame:
    """The same ``n`` rows (order), from as short a beginning of the table as will do; fewer than ``n`` are an error.

    A row's acceptance depends on those before it only, so beginnings are tried that double in length, as approximate quantiles of
    ``order`` give them: each is a filter that the scan takes, and its columns are read no further. What is read is at
    most about twice what the last beginning holds.
    """
    shares = [0.5**k for k in range(doublings, 0, -1)]
    ends = rows.agg(F.percentile_approx(order, shares).alias("ends")).first()["ends"]
    found = 0
    for end in [*(ends or []), None]:
        part = rows if end is None else rows.filter(F.col(order) <= F.lit(end))
        found = part.filter(ok).select(F.sha2(content.cast("binary"), 256).alias("h")).distinct().count()
        if found >= n:
            return accept_first(part, order, ok, content, n)
    raise ValueError(f"{n} rows were asked for, and the whole table has {found}")


def entity_split(entities: DataFrame, entity: str, salt: str, train_share: float = 0.8, seed_n: int = 0) -> DataFrame:
    """(entity, split): entities in hash order; the first share is train, of the rest the first seed_n are seed."""
    ranked = numbered(entities.select(entity, draw(salt, F.col(entity)).alias("h")), [], ["h", entity])
    cut = F.bround(F.col("n") * train_share)
    split = F.when(F.col("i") < cut, "train").when(F.col("i") < cut + seed_n, "seed").otherwise("ref")
    return ranked.select(entity, split.alias("split"))


def apportion(strata: DataFrame, label: str, total: int) -> DataFrame:
    """(label, n, quota): ``total`` seats by size, the rest by largest remainders (ties by label)."""
    exact = F.col("n") * total / F.sum("n").over(Window.partitionBy())
    base = strata.select(label, "n", F.floor(exact).alias("low"), (exact - F.floor(exact)).alias("frac"))
    order = Window.partitionBy().orderBy(F.desc("frac"), label)
    left = F.lit(total) - F.sum("low").over(Window.partitionBy())
    return base.select(label, "n", (F.col("low") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).alias("quota"))


def stratified_split(entities: DataFrame, entity: str, label: str, total: int, salt: str) -> DataFrame:
    """(entity, label, split): of each stratum, in hash order, its quota of ``total`` is chosen."""
    quotas = apportion(entities.groupBy(label).agg(F.count("*").alias("n")), label, total)
    ranked = numbered(entities.select(entity, label, draw(salt, F.col(entity)).alias("h")), [label], ["h", entity])
    ranked = ranked.join(quotas.select(label, "quota"), label)
    return ranked.select(entity, label, F.when(F.col("i") < F.col("quota"), "chosen").otherwise("rest").alias("split"))


def mad_gate(rows: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """(key, value, med, mad, outlier_raw, outlier_scaled): beyond median + k * MAD, raw and scaled by 1.4826."""
    med = quantiles(rows, [], F.col(value), {"med": 0.5})
    centred = rows.select(key, value).crossJoin(F.broadcast(med))  # one row
    mad = quantiles(centred, [], F.abs(F.col(value) - F.col("med")), {"mad": 0.5})
    told = centred.crossJoin(F.broadcast(mad))  # one row
    return told.select(key, value, "med", "mad", (F.col(value) > F.col("med") + k * F.col("mad")).alias("outlier_raw"), (F.col(value) > F.col("med") + k * 1.4826 * F.col("mad")).alias("outlier_scaled"))
