"""Bootstrap and permutation statistics on small samples of group values, by hash draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.draws import draw, draws
from millrace.plans.lineage import stash

from .ranking import numbered

#: Pooled samples of this size or more have too many assignments to go through (352,716 of 10 in 21); larger ones get sampled assignments.
EXACT_BELOW = 21
#: Statistics this close to the observed one, relative to it, count as equal: sums are added up in any order.
SLACK = 1e-9


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, a, b, delta) of keys on both sides, from frames (key, value)."""
    a, b = left.select(key, F.col("value").alias("a")), right.select(key, F.col("value").alias("b"))
    return a.join(b, key).withColumn("delta", F.col("a") - F.col("b"))


#: Partitions for the replicates that are joined with their draws. A number of their own, as Spark would put the few rows that they are made of into one.
SPREAD = 200


def replicates(values: DataFrame, group: list[str], order: str, measures: dict[str, Column], n_boot: int, salt: str = "boot", only: DataFrame | None = None) -> DataFrame:
    """(group, rep, measures): each replicate draws as many rows of its group as there are, with replacement; with ``only`` (group, rep), some of them.

    For measures that are neither sums nor medians; those are made by ``resampled_sums`` and ``resampled_medians``, without joining rows with
    their draws. A draw depends on the group, so that groups are drawn independently. The draws are joined with the rows by position;
    measures are aggregates of the drawn rows. Replicates are dealt to tasks before they are drawn; rows are group values, not raw data.
    """
    placed = numbered(values, group, [order])
    sizes = placed.groupBy(*group).agg(F.max("n").alias("n")) if group else placed.agg(F.max("n").alias("n"))
    drawn = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    if only is not None:
        asked = only.select(*(F.col(g).alias(f"{g}__") for g in group), F.col("rep").alias("rep__"))
        same = F.col("rep") == F.col("rep__")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
        drawn = drawn.join(asked, same, "left_semi")
    drawn = drawn.repartition(SPREAD, *group, "rep")
    drawn = drawn.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = drawn.withColumn("i", position(draw(salt, *map(F.col, group)), F.col("rep"), F.col("k"), F.col("n"))).drop("n", "k")
    rows = placed.drop("n").withColumnsRenamed({g: f"{g}__" for g in group}).withColumnRenamed("i", "i__")
    same = F.col("i") == F.col("i__").cast("bigint")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    return drawn.join(rows, same).groupBy(*group, "rep").agg(*(c.alias(m) for m, c in measures.items()))


#: Shifts and factors of the draws' mixture; factors are below 2**31, so that no product leaves 63 bits.
MIXERS = ((16, 2146121005), (15, 1812433253))
#: Values and replicates that a task works on at a time, and draws that it holds.
VALUES, REPLICATES, DRAWS = 1 << 16, 500, 1 << 18
#: Replicates that a task works on at a time where it holds their draws of a whole block of values.
FEW = 100
#: Standard deviations around an order statistic's expected place within which it is looked for. What lies beyond is done by Spark's own sort.
DEVIATIONS = 8


def positions(seed: np.ndarray, rep: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The position that each draw hits: a 32-bit mixture of the seed, the replicate and the number of the draw, modulo n."""
    low = np.uint64(0xFFFFFFFF)
    h = (seed.astype(np.uint64) + rep.astype(np.uint64) * np.uint64(2654435769) + k.astype(np.uint64) * np.uint64(2246822519)) & low
    for shift, factor in MIXERS:
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & low
    return ((h ^ (h >> np.uint64(16))) % n.astype(np.uint64)).astype(np.int64)


def position(seed: Column, rep: Column, k: Column, n: Column) -> Column:
    """The same as an expression."""
    low = F.lit(0xFFFFFFFF)
    h = (seed + rep * F.lit(2654435769) + k * F.lit(2246822519)).bitwiseAND(low)
    for shift, factor in MIXERS:
        h = (h.bitwiseXOR(F.shiftright(h, shift)) * F.lit(factor)).bitwiseAND(low)
    return F.pmod(h.bitwiseXOR(F.shiftright(h, 16)), n)


def resampled_sums(values: DataFrame, group: list[str], order: str, columns: list[str], n_boot: int, salt: str = "boot") -> DataFrame:
    """(group, rep, n, columns): for each replicate, which draws as many rows of its group as there are with replacement, the sums of the
    columns over the rows drawn. Draws depend on the group, so that groups are drawn independently.

    No row is joined with its draws. The rows are dealt to blocks of ``VALUES``, once for each ``REPLICATES`` replicates; a task makes the
    group's draws for its replicates, counts those that hit its block, and multiplies the counts with the block's columns.
    """
    named = values.select(*group, order, *(F.col(c).cast("double").alias(c) for c in columns))
    placed = numbered(named, group, [order]).select(*group, F.col("i").cast("bigint").alias("i"), "n", *columns)
    placed = placed.withColumn("seed__", draw(salt, *map(F.col, group))).withColumn("block__", F.floor(F.col("i") / VALUES))
    dealt = placed.withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // REPLICATES) - 1))))

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        n, seed, low = int(rows["n"].iloc[0]), rows["seed__"].iloc[0], int(rows["i"].iloc[0])
        x = rows[columns].to_numpy(float)
        reps = np.arange(key[-1] * REPLICATES + 1, min((key[-1] + 1) * REPLICATES, n_boot) + 1)
        out = np.concatenate([_weighted(hits, x) for hits in _hits(seed, reps, n, low, len(x))])
        told = {g: [v] * len(reps) for g, v in zip(group, key, strict=False)}
        return pd.DataFrame(told | {"rep": reps, "n": n} | {c: out[:, j] for j, c in enumerate(columns)})

    kinds = [f"`{g}` {values.schema[g].dataType.simpleString()}" for g in group] + ["rep bigint", "n bigint"] + [f"`{c}` double" for c in columns]
    each = dealt.groupBy(*group, "block__", "part__").applyInPandas(sums, ", ".join(kinds))
    return each.groupBy(*group, "rep").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in columns))


def _hits(seed: int, reps: np.ndarray, n: int, low: int, size: int):
    """For a few replicates at a time, how often each of the ``size`` rows from ``low`` on is drawn: at most DRAWS draws, or counts of one replicate."""
    step = max(1, DRAWS // n)
    for lo in range(0, len(reps), step):
        few = reps[lo : lo + step]
        hits = np.zeros(len(few) * size, np.int64)
        for first in range(0, n, DRAWS):
            k = np.arange(first, min(first + DRAWS, n))
            at = positions(np.uint64(seed), few[:, None], k[None, :], np.uint64(n)) - low
            inside = (at >= 0) & (at < size)
            hits += np.bincount((np.arange(len(few))[:, None] * size + at)[inside], minlength=len(hits))
        yield hits.reshape(len(few), size)


def _weighted(hits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The counts times the rows; a row that is not finite counts only where it is drawn."""
    odd = ~np.isfinite(x).all(axis=1)
    if not odd.any():
        return hits @ x
    out = hits[:, ~odd] @ x[~odd]
    for j in np.flatnonzero(odd):
        out[hits[:, j] > 0] += hits[hits[:, j] > 0, j, None] * x[j]
    return out


def _kinds(rows: DataFrame, group: list[str], *more: str) -> str:
    return ", ".join([*(f"`{g}` {rows.schema[g].dataType.simpleString()}" for g in group), *more])


def _keyed(group: list[str], key: tuple, n: int) -> dict[str, pa.Array]:
    """The group's columns for ``n`` rows of a result."""
    return {g: pa.array([v.as_py()] * n, v.type) for g, v in zip(group, key, strict=False)}


def resampled_medians(values: DataFrame, group: list[str], order: str, column: str, n_boot: int, salt: str = "boot") -> DataFrame:
    """(group, rep, stat): the median of the column over each replicate's rows, as by ``replicates``; nulls are drawn but do not count.

    Rows are dealt to blocks as in ``resampled_sums``. A replicate's median is close to the rows' own one: a task counts its block's draws
    of rows that lie below, and tells the counts of those within DEVIATIONS of it (a number that grows with the root of the group). Replicates
    whose median lies elsewhere are joined with their draws.
    """
    placed = numbered(values.select(*group, order, F.col(column).cast("double").alias("x")), group, [order]).withColumnsRenamed({"i": "at", "n": "size"})
    ranked = numbered(placed.filter("x is not null"), group, ["x", "at"]).select(*group, F.col("at").cast("bigint").alias("at"), F.col("size").cast("bigint").alias("size"), F.col("i").cast("bigint").alias("i"), "n", "x")
    ranked = ranked.withColumn("seed__", draw(salt, *map(F.col, group))).withColumn("block__", F.floor(F.col("at") / VALUES))
    dealt = ranked.withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(-(-n_boot // FEW) - 1))))

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        at, rank, x = (rows.column(c).to_numpy() for c in ("at", "i", "x"))
        size, n, seed = (rows.column(c)[0].as_py() for c in ("size", "n", "seed__"))
        block, part = key[-2].as_py(), key[-1].as_py()
        low, reach = block * VALUES, DEVIATIONS * 0.75 * np.sqrt(size) + 1
        reps = np.arange(part * FEW + 1, min((part + 1) * FEW, n_boot) + 1)
        below, near = rank < n / 2 - reach, np.abs(rank - n / 2) <= reach
        less, all_, told = [], [], []
        for hits in _hits(seed, reps, size, low, min(VALUES, size - low)):
            own = hits[:, at - low]
            less.append(own @ below.astype(np.int64)), all_.append(own.sum(axis=1)), told.append(own[:, near])
        columns = {"less": np.concatenate(less), "all_": np.concatenate(all_), "hits": np.concatenate(told).ravel(), "i": rank[near], "x": x[near]}
        return pa.table(_keyed(group, key, 1) | {"part__": pa.array([part], pa.int32())} | {c: pa.array([v], pa.list_(pa.float64() if c == "x" else pa.int64())) for c, v in columns.items()})

    def middle(key: tuple, blocks: pa.Table) -> pa.Table:
        lists = {c: [v.as_py() for v in blocks.column(c)] for c in ("less", "all_")} | {c: [v.values.to_numpy() for v in blocks.column(c)] for c in ("hits", "i", "x")}
        below, drawn = np.sum(lists["less"], axis=0), np.sum(lists["all_"], axis=0)
        order = np.argsort(np.concatenate(lists["i"]), kind="stable")
        x = np.concatenate(lists["x"])[order]
        upto = below[:, None] + np.cumsum(np.concatenate([h.reshape(len(below), -1) for h in lists["hits"]], axis=1)[:, order], axis=1)
        reps = key[-1].as_py() * FEW + 1 + np.arange(len(below))
        ends, found = [], drawn == 0
        stat = np.zeros(len(reps))
        if len(x):
            for place in ((drawn - 1) // 2, drawn // 2):
                ends.append(x[np.minimum((upto <= place[:, None]).sum(axis=1), len(x) - 1)])
            found = found | ((below <= (drawn - 1) // 2) & (upto[:, -1] > drawn // 2))
            stat = np.where(ends[0] == ends[1], ends[0], ends[0] + (ends[1] - ends[0]) / 2)
        return pa.table(_keyed(group, key, len(reps)) | {"rep": pa.array(reps, pa.int32()), "stat": pa.array(stat, mask=drawn == 0), "found": pa.array(found)})

    arrays = ("less array<bigint>", "all_ array<bigint>", "hits array<bigint>", "i array<bigint>", "x array<double>")
    blocks = dealt.groupBy(*group, "block__", "part__").applyInArrow(counted, _kinds(values, group, "part__ int", *arrays))
    told = stash(blocks.groupBy(*group, "part__").applyInArrow(middle, _kinds(values, group, "rep int", "stat double", "found boolean")), "medians")
    done, rest = told.filter("found").drop("found"), told.filter("not found")
    if rest.isEmpty():
        return done
    return done.unionByName(replicates(values, group, order, {"stat": F.percentile(column, 0.5)}, n_boot, salt, rest))


def interval(reps: DataFrame, group: list[str], value: str = "stat", alpha: float = 0.05) -> DataFrame:
    """(group, ci_low, ci_high): the percentile interval over the replicates."""
    ends = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return reps.groupBy(*group).agg(ends.alias("ci")).select(*group, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def contrast(deltas: DataFrame, group: list[str], order: str, n_boot: int) -> DataFrame:
    """(group, n, delta, ci_low, ci_high, excludes_zero): the mean difference and its bootstrap interval."""
    point = deltas.groupBy(*group).agg(F.count("*").alias("n"), F.avg("delta").alias("mean_delta"))
    ci = interval(resampled_sums(deltas, group, order, ["delta"], n_boot).withColumn("stat", F.col("delta") / F.col("n")), group)
    out = point.join(ci, group) if group else point.crossJoin(ci)  # one row each
    return out.withColumn("excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def exact_permutation(sample: DataFrame) -> DataFrame:
    """(observed, n_assignments, p_value, p_min) of the mean difference of sides a and b, over every way to
    deal out the pooled values. sample: (side, value, id), fewer than EXACT_BELOW rows."""
    pool = numbered(sample, [], ["id"]).select("i", "side", "value", "n")
    na, n = pool.filter("side = 'a'").count(), pool.count()
    if n >= EXACT_BELOW:
        raise ValueError(f"{n} values have too many assignments: sampled_permutation deals out some of them")
    ways = pool.select(F.array("i").alias("taken"), F.col("value").alias("sum_a"), F.col("i").alias("last"))
    for _ in range(na - 1):
        nxt = pool.select(F.col("i").alias("j"), F.col("value").alias("v"))
        ways = ways.join(nxt, F.col("j") > F.col("last")).select(F.concat("taken", F.array("j")).alias("taken"), (F.col("sum_a") + F.col("v")).alias("sum_a"), F.col("j").alias("last"))
    total = pool.agg(F.sum("value").alias("total"), F.max("n").alias("n"), (F.avg(F.when(F.col("side") == "a", F.col("value"))) - F.avg(F.when(F.col("side") == "b", F.col("value")))).alias("observed"))
    stat = F.col("sum_a") / na - (F.col("total") - F.col("sum_a")) / (F.col("n") - na)
    told = ways.crossJoin(total)  # one row of totals
    return told.groupBy("observed").agg(F.count("*").alias("n_assignments"), F.avg((F.abs(stat) >= F.abs("observed") - SLACK * F.greatest(F.lit(1.0), F.abs("observed"))).cast("double")).alias("p_value"), (2 / F.count("*")).alias("p_min"))


def _ordered(pool: DataFrame, group: list[str], reps: DataFrame) -> DataFrame:
    """(group, rep, s, c): the sum and number of the values of the first ``na`` rows in each of the hash orders ``reps`` (group, rep), by Spark's sort."""
    asked = reps.select(*(F.col(g).alias(f"{g}__") for g in group), "rep")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    dealt = pool.join(asked, same) if group else pool.crossJoin(asked)  # the orders asked for
    order = Window.partitionBy(*group, "rep").orderBy(draw("perm", *map(F.col, group), F.col("rep"), F.col("id"), F.col("side")), "i")
    first = dealt.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("na"))
    return first.groupBy(*group, "rep").agg(F.sum("value").alias("s"), F.count("value").alias("c"))


def sampled_permutation(sample: DataFrame, n_perm: int, group: list[str] | None = None) -> DataFrame:
    """The same by ``n_perm`` hash orders, each counted with the observed one: (1 + extreme) / (1 + n_perm), for each group.

    No order is sorted as a whole. Rows are dealt to blocks of VALUES, once for each FEW orders. The hash at which side a ends is known but for its
    deviation: a task adds up its rows below that range and tells those within it (a number that grows with the root of the group), of which
    the least complete the side. Orders that end elsewhere, as where rows have equal hashes, are left to Spark's sort.
    """
    group = group or []
    pool = numbered(sample.select(*group, "side", F.col("value").cast("double").alias("value"), "id"), group, ["id", "side"]).withColumn("i", F.col("i").cast("bigint"))
    means = F.avg(F.when(F.col("side") == "a", F.col("value"))) - F.avg(F.when(F.col("side") == "b", F.col("value")))
    sizes = pool.groupBy(*group).agg(F.count_if(F.col("side") == "a").alias("na"), means.alias("observed"), F.sum("value").alias("total"), F.count("value").alias("held"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    named = sizes.select(*(F.col(g).alias(f"{g}__") for g in group), "na")
    pool = (pool.join(named, same) if group else pool.crossJoin(named)).drop(*(f"{g}__" for g in group))  # one row for each group
    before, after = F.concat(F.concat_ws(":", F.lit("perm"), *(F.col(g).cast("string") for g in group)), F.lit(":")), F.concat_ws(":", F.lit(""), F.col("id").cast("string"), F.col("side").cast("string"))
    dealt = pool.select(*group, "i", "n", "na", "value", before.alias("before__"), after.alias("after__"), F.floor(F.col("i") / VALUES).alias("block__"))
    dealt = dealt.withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(-(-n_perm // FEW) - 1))))

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        n, na, before = (rows.column(c)[0].as_py() for c in ("n", "na", "before__"))
        part = key[-1].as_py()
        reps = np.arange(part * FEW + 1, min((part + 1) * FEW, n_perm) + 1)
        reach = DEVIATIONS * np.sqrt(na / n * (1 - na / n) / n) + 4 / n
        low, high = (int(np.clip(2**32 * (na / n + x), 0, 2**32)) for x in (-reach, reach))
        k, c, s = (np.zeros(len(reps), t) for t in (np.int64, np.int64, float))
        near: list[list[tuple]] = [[] for _ in reps]
        for lo in range(0, rows.num_rows, 1 << 15):
            some = rows.slice(lo, 1 << 15)
            value, i = some.column("value").combine_chunks(), some.column("i").to_numpy()
            held, x = value.is_valid().to_numpy(zero_copy_only=False), value.fill_null(0.0).to_numpy(zero_copy_only=False)
            h = draws(before, reps, np.array([v.encode() for v in some.column("after__").to_pylist()]))
            for r in range(len(reps)):
                below = h[r] < low
                at = np.flatnonzero(~below & (h[r] < high) if high < 2**32 else ~below)
                k[r] += np.count_nonzero(below)
                c[r] += np.count_nonzero(below & held)
                s[r] += x[below].sum()
                near[r].append((h[r][at], i[at], x[at], held[at]))
        joined = [[np.concatenate(p) for p in zip(*parts, strict=True)] for parts in near]
        lists = {"h": pa.int64(), "i": pa.int64(), "x": pa.float64(), "held": pa.bool_()}
        told = {"part__": pa.array([part] * len(reps), pa.int32()), "rep": pa.array(reps, pa.int32()), "k": pa.array(k), "c": pa.array(c), "s": pa.array(s)}
        told |= {"na": pa.array([na] * len(reps))} | {m: pa.array([p[j].astype(np.int64) if m in "hi" else p[j] for p in joined], pa.list_(t)) for j, (m, t) in enumerate(lists.items())}
        return pa.table(_keyed(group, key, len(reps)) | told)

    def ended(key: tuple, blocks: pa.Table) -> pa.Table:
        """The blocks of some orders: what completes side a is added."""
        rep = blocks.column("rep").to_numpy()
        k, c, s, na = (blocks.column(x).to_numpy() for x in "k c s na".split())
        lists = {x: blocks.column(x).combine_chunks() for x in ("h", "i", "x", "held")}
        out = []
        for r in np.unique(rep):
            own = np.flatnonzero(rep == r)
            h, i, x, held = (np.concatenate([v[int(j)].values.to_numpy(zero_copy_only=False) for j in own]) for v in lists.values())
            lacking = int(na[own[0]] - k[own].sum())
            first = np.lexsort((i, h))[: max(0, lacking)]
            out.append((int(r), float(s[own].sum() + x[first].sum()), int(c[own].sum() + held[first].sum()), 0 <= lacking <= len(h)))
        told = {m: pa.array([o[j] for o in out], t) for j, (m, t) in enumerate({"rep": pa.int32(), "s": pa.float64(), "c": pa.int64(), "found": pa.bool_()}.items())}
        return pa.table(_keyed(group, key, len(out)) | told)

    kinds = _kinds(sample, group, "part__ int, rep int, k bigint, c bigint, s double, na bigint, h array<bigint>, i array<bigint>, x array<double>, held array<boolean>")
    blocks = dealt.groupBy(*group, "block__", "part__").applyInArrow(added, kinds)
    reps = stash(blocks.groupBy(*group, "part__").applyInArrow(ended, _kinds(sample, group, "rep int, s double, c bigint, found boolean")), "orders")
    rest = reps.filter("not found")
    reps = reps.filter("found").drop("found")
    if not rest.isEmpty():
        reps = reps.unionByName(_ordered(pool, group, rest))
    sizes = sizes.withColumnsRenamed({g: f"{g}__" for g in group})
    reps = reps.join(F.broadcast(sizes), same) if group else reps.crossJoin(F.broadcast(sizes))  # one row for each group
    stat = F.try_divide("s", "c") - F.try_divide(F.col("total") - F.col("s"), F.col("held") - F.col("c"))
    reps = reps.withColumn("stat", stat)
    extreme = F.count_if(F.abs("stat") >= F.abs("observed") - SLACK * F.greatest(F.lit(1.0), F.abs("observed")))
    return reps.groupBy(*group, "observed").agg(F.count("*").alias("n_assignments"), ((1 + extreme) / (1 + F.count("*"))).alias("p_value"), (1 / (1 + F.count("*"))).alias("p_min"))


def gate(cells: DataFrame, group: list[str], reference: DataFrame, n_boot: int) -> DataFrame:
    """(group, n, early, late, difference, ci_low, ci_high, relative, extend): the paired gate.

    cells: (group, unit, bin, early, late), complete for each unit; reference: (bin, power). A profile is the variance
    over units by bin; its distance from the reference is the root mean square over bins of the difference of log10
    powers. Units are resampled, the same ones for both sides; extend if early is further away than late in the whole interval.
    Units are dealt to blocks as in ``resampled_sums``: no row is joined with its draws.
    """
    units = numbered(cells.select(*group, "unit").distinct(), group, ["unit"]).select(*group, "unit", F.col("i").cast("bigint").alias("i"), F.col("n").cast("bigint").alias("n"))
    own = cells.select(*(F.col(g).alias(f"{g}__") for g in group), F.col("unit").alias("unit__"), "bin", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("early", "late")))
    same = F.col("unit") == F.col("unit__")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}__"))
    before = F.concat(F.concat_ws(":", F.lit("gate"), *(F.col(g).cast("string") for g in group)), F.lit(":"))
    placed = units.join(own, same).select(*group, "i", "n", "bin", "early", "late", before.alias("before__"), F.floor(F.col("i") / VALUES).alias("block__"))
    dealt = placed.withColumn("part__", F.explode(F.sequence(F.lit(0), F.lit(n_boot // FEW))))

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Of a block of units, the sums by bin for some replicates. The group's draws are made anew for each block; those that hit it are counted."""
        n, before, low = int(rows["n"].iloc[0]), rows["before__"].iloc[0], int(key[-2]) * VALUES
        reps = np.arange(key[-1] * FEW, min((key[-1] + 1) * FEW, n_boot + 1))
        hits = np.zeros((len(reps), min(VALUES, n - low)), np.int32)
        for first in range(0, n, 1 << 15):
            k = np.arange(first, min(first + (1 << 15), n))
            at = draws(before, reps, np.char.add(b":", k.astype("S"))).astype(np.int64) % n
            at[reps == 0] = k  # replicate 0 takes each once
            at -= low
            for r, row in enumerate(at):
                hits[r] += np.bincount(row[(row >= 0) & (row < hits.shape[1])], minlength=hits.shape[1]).astype(np.int32)
        out = []
        for name, some in rows.groupby("bin", dropna=False):
            x = some[["early", "late"]].to_numpy(float)
            x = np.column_stack([x, x * x])
            w, at = np.zeros((len(reps), 4)), some["i"].to_numpy() - low
            for lo in range(0, len(at), 1 << 13):
                w += _weighted(hits[:, at[lo : lo + (1 << 13)]], x[lo : lo + (1 << 13)])
            out.append(pd.DataFrame({g: [v] * len(reps) for g, v in zip(group, key, strict=False)} | {"rep": reps, "bin": name, "n": n} | dict(zip(("e", "l", "ee", "ll"), w.T, strict=True))))
        return pd.concat(out)

    sums = dealt.groupBy(*group, "block__", "part__").applyInPandas(added, _kinds(cells, [*group], f"rep int, bin {cells.schema['bin'].dataType.simpleString()}, n bigint, e double, l double, ee double, ll double"))
    sums = sums.groupBy(*group, "rep", "bin").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in ("e", "l", "ee", "ll")))

    def power(x: str) -> Column:
        mean = F.col(x) / F.col("n")
        return F.col(x + x) / F.col("n") - mean * mean

    by_bin = sums.select(*group, "rep", "bin", power("e").alias("early"), power("l").alias("late"), "n")
    off = lambda side: F.sqrt(F.avg(F.pow(F.log10(side) - F.log10("power"), 2)))
    usable = by_bin.join(F.broadcast(reference), "bin").filter("early > 1e-12 and late > 1e-12 and power > 1e-12")  # a row for each bin
    told = usable.groupBy(*group, "rep").agg(off("early").alias("early"), off("late").alias("late"), F.max("n").alias("n")).withColumn("stat", F.col("early") - F.col("late"))
    point = told.filter("rep = 0").select(*group, "n", "early", "late", F.col("stat").alias("difference"))
    ci = interval(told.filter("rep > 0"), group)
    out = point.join(ci, group) if group else point.crossJoin(ci)  # one row each
    return out.withColumn("relative", F.try_divide("difference", F.col("early"))).withColumn("extend", F.col("ci_low") > 0)
