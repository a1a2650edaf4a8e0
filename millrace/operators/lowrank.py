"""Principal components of wide vectors, and distances between sets of feature vectors with their bootstrap.

Components come from a randomised range finder: tasks add up products of their rows with a thin matrix, and only
matrices of the width times a few columns are sent anywhere. No matrix of width times width is made. Distances
between sets are sums over pairs of blocks; a bootstrap carries the counts of all replicates with each row, so one pass makes all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.draws import draw
from millrace.plans.lineage import stash

from .ranking import numbered
from .vectors import BLOCK_BYTES, STEP_BYTES, _equal, _met, _stacked

#: Columns beside those asked for, and rounds that sharpen them.
OVERSAMPLING, ROUNDS = 10, 4
#: Rows of a thin matrix in one row of its table.
CHUNK = 256
#: Bytes of the replicates' moments that a task holds: as many replicates as fit are made in one pass.
MOMENT_BYTES = 1 << 27


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "vec") -> Iterator[np.ndarray]:
    """The vectors of Arrow batches as matrices of at most BLOCK_BYTES."""
    for batch in batches:
        vec = batch.column(column)
        if not len(vec):
            continue
        width = len(vec[0])
        step = max(1, BLOCK_BYTES // (8 * max(1, width)))
        for lo in range(0, len(vec), step):
            part = vec.slice(lo, step)
            yield part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(part), width)


def _added_up(rows: DataFrame, work, columns: int) -> np.ndarray:
    """The sum over all rows of ``work``, a (height, ``columns``) matrix for each matrix of rows: added up in each task, then piece
    by piece of CHUNK rows, and collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            y = work(x)
            total = y if total is None else total + y
        if total is not None:
            for lo in range(0, len(total), CHUNK):
                part = total[lo : lo + CHUNK]
                yield pa.RecordBatch.from_pydict({"at": pa.array([lo]), "part": pa.array([part.ravel().tolist()], pa.list_(pa.float64()))})

    parts = rows.select("vec").mapInArrow(run, "at bigint, part array<double>")
    summed = parts.groupBy("at").applyInArrow(_sum_parts, "at bigint, part array<double>").toPandas().sort_values("at")
    return np.concatenate([np.array(p).reshape(-1, columns) for p in summed["part"]]) if len(summed) else np.zeros((0, columns))


def _sum_parts(table: pa.Table) -> pa.Table:
    """Rows with one ``at``, one for each task: their parts added up."""
    column = table.column("part").combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).sum(axis=0)
    return pa.table({"at": table.column("at").slice(0, 1), "part": pa.array([x.tolist()], pa.list_(pa.float64()))})


@dataclass
class Components:
    """Leading components of a set of vectors: a column each, its largest loading positive."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float
    n: int

    def scores(self, vec: Column, spark: SparkSession) -> Column:
        """A vector's projections on the components, as an array."""
        shared = spark.sparkContext.broadcast((self.mean, self.axes))

        def run(column: pa.Array) -> pa.Array:
            mean, axes = shared.value
            parts = [(x - mean) @ axes for x in _matrices([pa.RecordBatch.from_arrays([column], ["vec"])])]
            y = np.concatenate(parts) if parts else np.zeros((0, axes.shape[1]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * axes.shape[1], pa.int32()), pa.array(y.ravel()))

        return F.arrow_udf(run, "array<double>").asNondeterministic()(vec)

    def rank(self, tolerance: float = 1e-10) -> int:
        """Components whose variance is above ``tolerance`` of the first one's; all of them only if all were asked for."""
        return int((self.variance > tolerance * self.variance[0]).sum()) if len(self.variance) and self.variance[0] > 0 else 0

    def for_share(self, share: float) -> int | None:
        """The fewest components that hold ``share`` of the total variance; None if those at hand don't."""
        part = np.cumsum(self.variance) / self.total if self.total > 0 else np.zeros(0)
        enough = np.flatnonzero(part >= share - 1e-12)
        return int(enough[0]) + 1 if len(enough) else None


def components(rows: DataFrame, n: int, rounds: int = ROUNDS, oversampling: int = OVERSAMPLING, seed: int = 0) -> Components:
    """The ``n`` leading components of the rows (vec): fitted to at least n + 1 vectors of one length, without nulls.

    A round multiplies the covariance with a thin orthonormal matrix, in one pass over the rows, and makes the
    result orthonormal on the driver: width times (n + oversampling) numbers. If that is the whole width, the components are exact.
    """
    spark = rows.sparkSession
    sums = _added_up(rows, lambda x: np.column_stack([x.sum(axis=0), np.full(x.shape[1], len(x)), (x * x).sum(axis=0)]), 3)
    count = int(sums[0, 1]) if len(sums) else 0
    if n < 1 or count < n + 1:
        raise ValueError(f"{n} components need at least {n + 1} vectors, not {count}")
    width, mean = len(sums), sums[:, 0] / count
    thin = min(width, n + oversampling)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, thin)))[0]
    for _ in range(rounds if thin < width else 0):
        shared = spark.sparkContext.broadcast((mean, basis))

        def turned(x: np.ndarray, shared=shared) -> np.ndarray:
            mean, basis = shared.value
            return (x - mean).T @ ((x - mean) @ basis)

        basis = np.linalg.qr(_added_up(rows, turned, thin))[0]
    shared = spark.sparkContext.broadcast((mean, basis))

    def small(x: np.ndarray) -> np.ndarray:
        mean, basis = shared.value
        y = (x - mean) @ basis
        return y.T @ y

    values, vectors = np.linalg.eigh(_added_up(rows, small, thin) / (count - 1))
    order = np.argsort(-values)[:n]
    axes = basis @ vectors[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    total = float(np.maximum(sums[:, 2] - count * mean * mean, 0).sum() / (count - 1))
    return Components(mean, axes, np.maximum(values[order], 0), total, count)


# ---- distances between sets of features -------------------------------------------------------------------------


def root_trace(a: np.ndarray, b: np.ndarray) -> float:
    """The trace of the square root of a product of two covariance matrices."""
    w, v = np.linalg.eigh(a)
    root = v * np.sqrt(np.maximum(w, 0)) @ v.T
    return float(np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum())


def weighted(rows: DataFrame, n_boot: int, salt: str = "features") -> DataFrame:
    """``rows`` (id, vec) with w, an array of n_boot + 1 counts: 1, then how often each replicate draws the row, with replacement."""
    placed = stash(numbered(rows.select("id", "vec"), [], ["id"]).select("id", "vec", F.col("i").cast("bigint").alias("i"), "n"), "placed")
    drawn = placed.select("i", "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    drawn = drawn.select("rep", F.pmod(draw(salt, F.col("rep"), F.col("i")), F.col("n")).alias("i"))
    counts = drawn.groupBy("i", "rep").agg(F.count("*").alias("k")).groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("rep", "k"))).alias("k"))
    each = F.transform(F.sequence(F.lit(0), F.lit(n_boot)), lambda r: F.when(r == 0, F.lit(1)).otherwise(F.coalesce(F.element_at("k", r), F.lit(0))).cast("smallint"))
    return placed.join(counts, "i", "left").select("id", "vec", each.alias("w"))


def bootstrap_frechet(sample: DataFrame, reference: DataFrame, n_boot: int, salt: str = "features") -> DataFrame:
    """(rep, distance): the squared Fréchet distance between Gaussians fitted to the sample and to the reference; replicate 0 is
    the sample itself, the others draw it anew, with the reference as it is.

    All replicates' moments are added up in one pass, or in as many as MOMENT_BYTES asks for; each replicate's
    eigenvalues are found in a task of its own. A few matrices of the width squared have to fit there.
    """
    spark = sample.sparkSession
    held = stash(weighted(sample, n_boot, salt), "weighted")
    first = reference.select(F.size("vec").alias("d")).first()
    at_once = max(1, MOMENT_BYTES // (8 * ((first["d"] if first else 1) + 1) ** 2))
    ends = [(lo, min(lo + at_once, n_boot + 1)) for lo in range(0, n_boot + 1, at_once)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one group of replicates: (rep, n, moments)."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lo = batch.column("lo")[0].as_py() if len(batch) else 0
            at = 0
            for x in _matrices([batch]):
                w = batch.column("w").slice(at, len(x)).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(float)
                at += len(x)
                y = np.column_stack([np.ones(len(x)), x])
                for r in range(w.shape[1]):
                    m = (y * w[:, r, None]).T @ y
                    total[lo + r] = m if lo + r not in total else total[lo + r] + m
        for r, m in total.items():
            yield pa.RecordBatch.from_pydict({"rep": pa.array([r], pa.int32()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    sums = None
    for lo, hi in ends:  # each group of replicates is a scan of its own with a bounded number of matrices
        part = held.select(F.lit(lo).alias("lo"), "vec", F.slice("w", lo + 1, hi - lo).alias("w")).mapInArrow(partial, "rep int, m array<double>")
        sums = part if sums is None else sums.unionByName(part)
    once = reference.select(F.lit(0).alias("lo"), "vec", F.array(F.lit(1)).alias("w")).mapInArrow(partial, "rep int, m array<double>")
    shared = spark.sparkContext.broadcast(_moments(reduce(np.add, (np.array(r["m"]) for r in once.toLocalIterator()))))  # a task's matrix at a time

    def distance(parts: pd.DataFrame) -> pd.DataFrame:
        (ma, ca), (mb, cb) = _moments(np.sum(np.stack(parts["m"]), axis=0)), shared.value
        d = ((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * root_trace(cb, ca)
        return pd.DataFrame({"rep": parts["rep"][:1], "distance": [float(d)]})

    return sums.groupBy("rep").applyInPandas(distance, "rep int, distance double")


def _moments(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance from the sums of products of (1, x)."""
    d = int(round(np.sqrt(flat.size)))
    m = flat.reshape(d, d)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return mean, (m[1:, 1:] - n * np.outer(mean, mean)) / (n - 1)


def bootstrap_kernel(sample: DataFrame, reference: DataFrame, n_boot: int, salt: str = "features") -> DataFrame:
    """(rep, distance): the unbiased squared kernel distance with the kernel (x.y / d + 1)**3; replicates as above. A row that is
    drawn twice is a pair with itself, as the copies are two rows of the replicate.

    Each pair of blocks is worked on once, for all replicates: the kernel's matrix between the two sides' counts.
    """
    sample_w = stash(weighted(sample, n_boot, salt), "weighted")
    ones = reference.select("id", "vec", F.array(F.lit(1).cast("smallint")).alias("w"))

    def sums(one: DataFrame, two: DataFrame, name: str, own: bool) -> DataFrame:
        left = one.select(F.col("id").alias("l_id"), F.col("vec").alias("lv"), F.col("w").alias("lw"))
        right = two.select(F.col("id").alias("r_id"), F.col("vec").alias("rv"), F.col("w").alias("rw"))

        def total(p: dict, q: dict, twin: bool) -> Iterator[pd.DataFrame]:
            u, v, a, b = p["lv"], q["rv"], *(w.reshape(n, -1).astype(float) for w, n in ((p["lw"], len(p["lv"])), (q["rw"], len(q["rv"]))))
            s = np.zeros(max(a.shape[1], b.shape[1]))
            step = max(1, STEP_BYTES // (8 * max(len(v), u.shape[1])))
            for lo in range(0, len(u), step):
                k = u[lo : lo + step] @ v.T / u.shape[1] + 1
                # The sum over pairs of a replicate's counts; each drawn row is no pair with itself.
                s = s + (((k * k * k) @ b) * a[lo : lo + step]).sum(axis=0)
            if own and twin:
                i, j = _equal(p["l_id"], q["r_id"])
                s = s - ((((u[i] * v[j]).sum(axis=1) / u.shape[1] + 1) ** 3)[:, None] * a[i]).sum(axis=0)
            yield pd.DataFrame({"rep": np.arange(len(s), dtype=np.int32), "s": s if twin or not own else 2 * s})

        done = _met(left, right, total, "rep int, s double", half=own)
        return done.groupBy("rep").agg(F.sum("s").alias(name))

    n = sample.agg(F.count("*").alias("na")).crossJoin(reference.agg(F.count("*").alias("nb")))  # one row each
    rr = sums(ones, ones, "bb", True).select("bb")  # one row
    both = sums(sample_w, sample_w, "aa", True).join(sums(sample_w, ones, "ab", False), "rep").crossJoin(rr).crossJoin(n)
    na, nb = F.col("na"), F.col("nb")
    return both.select("rep", (F.col("aa") / (na * (na - 1)) + F.col("bb") / (nb * (nb - 1)) - 2 * F.col("ab") / (na * nb)).alias("distance"))


def summary(replicates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(distance, ci_low, ci_high, n_boot) from (rep, distance): replicate 0 and the percentile interval of the others."""
    ends = F.percentile(F.when(F.col("rep") > 0, F.col("distance")), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    point = F.max(F.when(F.col("rep") == 0, F.col("distance")))
    out = replicates.agg(point.alias("distance"), ends.alias("ci"), F.count_if(F.col("rep") > 0).alias("n_boot"))
    return out.select("distance", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "n_boot")


def kernel_subsets(a: DataFrame, b: DataFrame, subsets: int = 100, most: int = 1000, salt: str = "subset") -> DataFrame:
    """(subset, size, distance): the unbiased squared kernel distance between ``size`` rows of either side, drawn without
    replacement anew for each subset; ``size`` is the smaller side's number of rows, ``most`` at most.

    Rows are kept by the rank of a hash, which tasks cut down to ``size`` rows a subset before anything is shuffled; each subset is
    worked on in a task of its own, which holds two times ``size`` vectors.
    """
    size = min(a.count(), b.count(), most)

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        many = rows.select("id").withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit(subsets))))
        order = Window.partitionBy("subset").orderBy(draw(salt, side, F.col("subset"), F.col("id")), "id")
        kept = many.select("subset", "id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= size).drop("r")
        return kept.join(rows.select(F.col("id").alias("v_id"), "vec"), F.col("id") == F.col("v_id")).select(*(F.col(c).alias(c) for c in ("subset", "id", "vec")))

    def one(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, y = _stacked(p["vec"]), _stacked(q["vec"])
        m, d = len(x), x.shape[1]
        k = lambda u, v: (u @ v.T / d + 1) ** 3
        inner = sum(z.sum() - np.trace(z) for z in (k(x, x), k(y, y))) / (m * (m - 1)) if m > 1 else np.nan
        return pd.DataFrame({"subset": p["subset"][:1], "size": [m], "distance": [inner - 2 * k(x, y).sum() / (m * m)]})

    x, y = dealt(a, "a"), dealt(b, "b")
    return x.groupBy("subset").cogroup(y.groupBy("subset")).applyInPandas(one, "subset int, size bigint, distance double")
