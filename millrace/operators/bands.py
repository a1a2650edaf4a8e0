"""Cosine modes of square arrays that are stored as vectors, row by row: array in, array out.

Transforms are products with the orthonormal cosine matrix over Arrow batches, a bounded number of arrays at a time;
sums over arrays are made within each task, so that a task sends as many rows as an array has values (and groups are
found in it). A null array gives null; one of another length or with a value that is not a finite number is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of the arrays that are transformed at a time.
STEP_BYTES = 1 << 23


def cosines(side: int) -> np.ndarray:
    """The orthonormal cosine matrix: a row for each frequency."""
    k, x = np.arange(side)[:, None], np.arange(side)[None, :]
    return np.where(k == 0, np.sqrt(1 / side), np.sqrt(2 / side)) * np.cos(np.pi * (2 * x + 1) * k / (2 * side))


def forward(x: np.ndarray) -> np.ndarray:
    """The modes of a stack of arrays."""
    c = cosines(x.shape[-1])
    return c @ x @ c.T


def inverse(x: np.ndarray) -> np.ndarray:
    c = cosines(x.shape[-1])
    return c.T @ x @ c


def eigenvalues(side: int) -> np.ndarray:
    """Of the heat equation, by mode."""
    k = np.arange(side)
    return np.pi**2 * (k[:, None] ** 2 + k[None, :] ** 2) / side**2


def damping(side: int, sigma: float) -> np.ndarray:
    """What heat of width ``sigma`` leaves of each mode."""
    if not (np.isfinite(sigma) and sigma >= 0):
        raise ValueError(f"sigma has to be a finite number of at least 0, not {sigma!r}")
    return np.exp(-eigenvalues(side) * sigma**2 / 2)


def cycles(side: int) -> np.ndarray:
    """Cycles across the array, by mode."""
    k = np.arange(side)
    return np.sqrt(k[:, None] ** 2.0 + k[None, :] ** 2) / 2


def octaves(side: int) -> list[np.ndarray]:
    """Masks of the octaves from half a cycle up to side / 2 cycles, the last one closed at its upper end."""
    r, low, out = cycles(side), 0.5, []
    while low < side / 2:
        high = 2 * low
        out.append((r >= low) & ((r < high) | ((high >= side / 2) & (r <= side / 2))) & (r <= side / 2))
        low = high
    return out


def stacks(column: pa.Array, side: int) -> Iterator[np.ndarray]:
    """The arrays of a list column, but for nulls, a bounded number at a time."""
    column = column.drop_null()
    wide = side * side
    step = max(1, STEP_BYTES // (8 * wide))
    for lo in range(0, len(column), step):
        part = column.slice(lo, step)
        if not pc.all(pc.equal(pc.list_value_length(part), wide)).as_py():
            raise ValueError(f"expected arrays of {side} x {side} values")
        x = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        if not np.isfinite(x).all():
            raise ValueError("an array holds a value that is null or not finite")
        yield x.reshape(-1, side, side)


def mapped(vec: Column, side: int, work: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> Column:
    """``work`` on every array: (n, side, side) in, (n, ..) out; a result with more axes is a list of lists (``kind``)."""

    def run(column: pa.Array) -> pa.Array:
        done = [work(x) for x in stacks(column, side)]
        shape = done[0].shape[1:] if done else (0,) * (kind.count("array"))
        values = pa.array(np.concatenate([d.ravel() for d in done]) if done else np.zeros(0))
        valid = pc.is_valid(column).to_numpy(zero_copy_only=False)
        nested = kind.count("array")
        inner = int(np.prod(shape[nested - 1 :]))
        for k in range(nested - 1, 0, -1):  # from the inside out
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, inner or 1), pa.int32()), values)
            inner = int(np.prod(shape[k - 1 : k]))
        ends = np.concatenate([[0], np.cumsum(np.where(valid, inner, 0))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(~valid))

    return F.arrow_udf(run, kind).asNondeterministic()(vec)


def modes(vec: Column, side: int) -> Column:
    """The orthonormal cosine modes of each array."""
    return mapped(vec, side, forward)


def low_pass(vec: Column, side: int, sigma: float) -> Column:
    """Each array after heat of width ``sigma`` (in cells) has run through it; 0 leaves it as it is."""
    kept = damping(side, sigma)
    return mapped(vec, side, lambda x: inverse(forward(x) * kept) if sigma else x)


def parts(vec: Column, side: int) -> Column:
    """Each array as a sum of arrays: its octaves, the coarsest first, its mean, and the corner modes beyond side / 2 cycles."""
    masks = octaves(side)
    mean = cycles(side) == 0
    masks = np.stack([*masks, mean, ~(np.logical_or.reduce(masks) | mean)])
    return mapped(vec, side, lambda x: inverse(forward(x)[:, None] * masks).reshape(len(x), len(masks), -1), "array<array<double>>")


def synthesised(coefficients: Column, side: int) -> Column:
    """The arrays whose modes are given: the inverse of ``modes``."""
    return mapped(coefficients, side, inverse)


def window(vec: Column, side: int, level: float) -> Column:
    """A struct (row0, row1, col0, col1), half-open: the smallest square around all values above ``level``, centred on
    them as far as the array allows; the whole array if there are none."""
    at = F.sequence(F.lit(0), F.lit(side - 1))
    rows = F.filter(at, lambda r: F.exists(F.slice(vec, r * side + 1, F.lit(side)), lambda x: x > level))
    cols = F.filter(at, lambda c: F.exists(at, lambda r: F.get(vec, r * side + c) > level))
    span = lambda a: F.array_max(a) - F.array_min(a) + 1
    size = F.greatest(span(rows), span(cols))

    def first(a: Column) -> Column:
        middle = F.floor((F.array_min(a) + F.array_max(a) + 1 - size) / 2).cast("int")
        return F.least(F.greatest(middle, F.lit(0)), side - size)

    r, c = first(rows), first(cols)
    found = F.struct(r.alias("row0"), (r + size).alias("row1"), c.alias("col0"), (c + size).alias("col1"))
    whole = F.struct(F.lit(0).alias("row0"), F.lit(side).alias("row1"), F.lit(0).alias("col0"), F.lit(side).alias("col1"))
    return F.when(vec.isNotNull(), F.when(F.size(rows) > 0, found).otherwise(whole))


def centred(vec: Column) -> Column:
    """Each vector without its mean."""
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x) / F.size(vec)
    return F.transform(vec, lambda x: x.cast("double") - mean)


def thumbnail(vec: Column, side: int, small: int) -> Column:
    """Each array as small x small means of squares, centred and of length one; a flat array gives zeros."""
    cell = side // small
    if cell * small != side:
        raise ValueError(f"{small} does not divide {side}")

    def work(x: np.ndarray) -> np.ndarray:
        y = x.reshape(len(x), small, cell, small, cell).mean(axis=(2, 4)).reshape(len(x), -1)
        y -= y.mean(axis=1, keepdims=True)
        length = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return np.divide(y, length, out=np.zeros_like(y), where=length > 1e-12)

    return mapped(vec, side, work)


def mode_sums(rows: DataFrame, vec: str, side: int, group: str | None = None, transform: bool = True) -> DataFrame:
    """(group, pos, n, s, q): for each value of the arrays' modes (or of the arrays themselves) the number, sum and sum of squares over all rows."""
    kind = [f"`{group}` {rows.schema[group].dataType.simpleString()}"] if group else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            labels = batch.column(group).to_pylist() if group else [None] * len(batch)
            for label in dict.fromkeys(labels):
                own = batch.column(vec).filter(pa.array([x == label for x in labels])) if group else batch.column(vec)
                for x in stacks(own, side):
                    y = (forward(x) if transform else x).reshape(len(x), -1)
                    n, s, q = sums.get(label, (0, 0.0, 0.0))
                    sums[label] = n + len(y), s + y.sum(axis=0), q + (y * y).sum(axis=0)
        for label, (n, s, q) in sums.items():
            columns = {group: pa.array([label] * len(s), batch.schema.field(group).type)} if group else {}
            columns |= {"pos": pa.array(np.arange(len(s)), pa.int32()), "n": pa.array(np.full(len(s), n)), "s": pa.array(s), "q": pa.array(q)}
            yield pa.RecordBatch.from_pydict(columns)

    named = rows.select(*([group] if group else []), vec)
    partial = named.mapInArrow(run, ", ".join([*kind, "pos int, n bigint, s double, q double"]))
    return partial.groupBy(*([group] if group else []), "pos").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))


def mode_power(rows: DataFrame, vec: str, side: int) -> DataFrame:
    """(i, j, power): the population variance of each mode over the rows, the mean mode's as 0."""
    sums = mode_sums(rows, vec, side)
    i, j = (F.col("pos") / side).cast("int"), (F.col("pos") % side).cast("int")
    mean = F.col("s") / F.col("n")
    return sums.select(i.alias("i"), j.alias("j"), F.when(F.col("pos") == 0, 0.0).otherwise(F.col("q") / F.col("n") - mean * mean).alias("power"))


def within_group(rows: DataFrame, vec: str, side: int, group: str) -> DataFrame:
    """(group, n, diversity): the squared distance of the arrays from their group's mean, per array and per value less one."""
    sums = mode_sums(rows, vec, side, group, transform=False)
    spread = F.sum("q") - F.sum(F.col("s") * F.col("s") / F.col("n"))
    return sums.groupBy(group).agg(F.max("n").alias("n"), (spread / F.max("n") / (side * side - 1)).alias("diversity"))


def inherited(samples: DataFrame, seeds: DataFrame, power: DataFrame, side: int, sigma: float, low_band: float | None = None) -> DataFrame:
    """(i, j, measured, predicted, power, in_band): by mode, the samples' mean squared distance from their own seed's damped mode,
    over the reference's power, and what damping of width ``sigma`` predicts of it.

    samples: (key, vec); seeds: (key, vec), one for each key; power: (i, j, power). Means are removed from all arrays. With ``low_band``,
    only modes whose own width is at least that many cells are in the band.
    """
    kept = damping(side, sigma)
    seed = seeds.select("key", mapped(centred(F.col("vec")), side, lambda x: forward(x) * kept).alias("prior"))
    own = samples.select("key", modes(centred(F.col("vec")), side).alias("mode")).join(seed, "key")
    off = own.select(F.zip_with("mode", "prior", lambda x, p: x - p).alias("off"))
    residual = mode_sums(off, "off", side, transform=False).select((F.col("pos") / side).cast("int").alias("i"), (F.col("pos") % side).cast("int").alias("j"), (F.col("q") / F.col("n")).alias("v"))
    square = F.col("i") * F.col("i") + F.col("j") * F.col("j")
    lam = float(np.pi**2 / side**2) * square
    band = (square > 0) & (lam <= 2 / low_band**2 if low_band else F.lit(True))
    return residual.join(power, ["i", "j"]).select(
        "i",
        "j",
        F.when(square == 0, 0.0).otherwise(F.col("v")).alias("residual"),
        F.when((square > 0) & (F.col("power") > 0), F.col("v") / F.col("power")).otherwise(0.0).alias("measured"),
        (1 - F.exp(-lam * sigma * sigma)).alias("predicted"),
        F.when(square > 0, F.col("power")).otherwise(0.0).alias("power"),
        band.alias("in_band"),
    )


def inherited_shares(by_mode: DataFrame) -> DataFrame:
    """(measured, predicted): the shares of the reference's power in the band that the samples take over from their seeds; null without power."""
    total = F.sum(F.when(F.col("in_band"), F.col("power")))
    measured = 1 - F.sum(F.when(F.col("in_band"), F.col("residual"))) / total
    predicted = F.sum(F.when(F.col("in_band"), F.col("power") * (1 - F.col("predicted")))) / total
    return by_mode.agg(F.when(total > 0, measured).alias("share_measured"), F.when(total > 0, predicted).alias("share_predicted"))
