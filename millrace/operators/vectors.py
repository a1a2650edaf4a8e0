"""Exact vector analytics: neighbours, near-duplicate pairs, precision/recall/density/coverage, dimension, diversity.

Distances are exact. Both sides are cut into blocks of bounded size, a row each, and pairs of blocks are worked on
in tasks of their own; only the best k of each row (or the pairs beyond a threshold) leave a task. Products in single precision
with a bound on their error leave few pairs whose differences are looked at. A search for neighbours
leaves out the pairs of blocks that the triangle inequality rules out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.lineage import stash

#: Vectors in a block, and the bytes that a block's doubles and a step's differences may take, however wide the vectors are.
BLOCK, BLOCK_BYTES, STEP_BYTES = 1 << 11, 1 << 25, 1 << 24
#: Bytes of a block that is passed on as one row, pairs of blocks that tables of enough rows make at least, and columns of a step.
PACK_BYTES, PAIRS, COLUMNS = 1 << 24, 64, 1 << 12
#: Bytes of a step's products, which stay in a core's cache, and of the pairs of blocks that Python gets at once.
PRODUCT_BYTES, BATCH_BYTES = 1 << 21, 1 << 20
#: Pivots for pruning: at most so many, and so many bytes of them.
PIVOTS, PIVOT_BYTES = 1 << 10, 1 << 23


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows from the differences, so that equal vectors are at 0 whatever the block."""
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _steps(x: np.ndarray, y: np.ndarray):
    """(first row, distances to y) of as many rows of x at a time as STEP_BYTES allows."""
    rows = max(1, STEP_BYTES // max(1, 8 * y.size))
    for lo in range(0, len(x), rows):
        yield lo, distances(x[lo : lo + rows], y)


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(float)


def unit(vector: Column) -> Column:
    """Centred and scaled to length one, as doubles; what is flat has no direction and gives NaN."""

    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten().cast(pa.float64())  # without nulls
        x = flat.to_numpy(zero_copy_only=False)
        sizes = np.diff(column.offsets.to_numpy()) * column.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros(len(x))
        with np.errstate(invalid="ignore", divide="ignore"):
            for width in np.unique(sizes[sizes > 0]):
                at = ends[:-1][sizes == width][:, None] + np.arange(width)
                y = x[at] - x[at].mean(axis=1, keepdims=True)
                out[at] = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=column.is_null())

    return F.arrow_udf(run, "array<double>").asNondeterministic()(vector)


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """A row for each block: its number and, for each other column, a list of its values; lists are put one after another."""
    fields = [f for f in rows.schema if f.name != block]
    kinds = [t if (t := f.dataType.simpleString()).startswith("array") else f"array<{t}>" for f in fields]
    names = [f.name for f in fields]

    def pack(table: pa.Table) -> pa.Table:
        out = {block: table.column(block).slice(0, 1)}
        for c in names:
            column = pa.concat_arrays(table.column(c).chunks)
            flat = column.flatten() if pa.types.is_list(column.type) else column
            out[c] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        return pa.table(out)

    shape = ", ".join([f"`{block}` {rows.schema[block].dataType.simpleString()}", *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))])
    return rows.groupBy(block).applyInArrow(pack, shape)


def _width(rows: DataFrame) -> int:
    """Doubles that a row takes as much room as, as its first row has them."""
    lists = [F.ceil(F.size(f.name) / (4 if f.dataType.simpleString() == "array<smallint>" else 1)) for f in rows.schema if f.dataType.typeName() == "array"]
    first = rows.select(sum(lists, F.lit(1)).alias("w")).first()
    return max(1, first["w"]) if first else 1


def _fits(width: int) -> int:
    return max(1, PACK_BYTES // (8 * width))


def _blocks(n: tuple[int, int], width: tuple[int, int], pairs: int) -> tuple[int, int]:
    """How many blocks two sides of so many rows are cut into. Each side is sent to every block of the other, so the smaller side has the fewer
    blocks: as many as it takes for a block to fit, and for so many pairs of at least BLOCK rows a side."""
    least = [max(1, -(-k // _fits(w))) for k, w in zip(n, width, strict=True)]
    most = [max(a, -(-k // BLOCK)) for a, k in zip(least, n, strict=True)]
    within = lambda side, k: min(max(k, least[side]), most[side])
    a = within(0, round((pairs * n[0] * width[0] / max(1, n[1] * width[1])) ** 0.5))
    b = within(1, -(-pairs // a))
    return within(0, -(-pairs // b)), b


def _one_by_one(spark: SparkSession) -> None:
    """Python gets few pairs of blocks at once, not 64 MB of them, unless the setting was changed."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def _met(left: DataFrame, right: DataFrame, work: Callable[[dict, dict, bool], Iterator[pd.DataFrame]], schema: str, half: bool = False) -> DataFrame:
    """What ``work`` yields for each pair of a block of the left rows (l_id, ..) and one of the right (r_id, ..): both as arrays by column name, and
    whether the blocks have the same number. ``half``, for two sides with the same ids: only pairs of blocks in order."""
    _one_by_one(left.sparkSession)
    nl, nr = _blocks((left.count(), right.count()), (_width(left), _width(right)), PAIRS)
    if half:
        nl = nr = max(nl, nr)
    a = _packed(left.withColumn("lb", F.pmod(F.xxhash64("l_id"), F.lit(nl))), "lb").withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nr - 1).cast("bigint"))))
    b = _packed(right.withColumn("rb", F.pmod(F.xxhash64("r_id"), F.lit(nr))), "rb").withColumn("lb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nl - 1).cast("bigint"))))
    if half:
        a, b = a.filter("lb <= rb"), b.filter("lb <= rb")
    names = left.columns, right.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = ({c: _values(batch.column(c), r) for c in side} for side in names)
                for m, key in ((x, "l_id"), (y, "r_id")):
                    m |= {c: v.reshape(len(m[key]), -1) for c, v in m.items() if len(v) != len(m[key]) or c in ("lv", "rv")}
                for out in work(x, y, batch.column("lb")[r].as_py() == batch.column("rb")[r].as_py()):
                    if len(out):
                        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return a.join(b, ["lb", "rb"]).mapInArrow(run, schema)


def _values(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of equal ids."""
    both = pd.DataFrame({"id": a, "i": np.arange(len(a))}).merge(pd.DataFrame({"id": b, "j": np.arange(len(b))}), on="id")
    return both["i"].to_numpy(), both["j"].to_numpy()


class _Screen:
    """Squared distances in single precision, in units of ``scale``, with a bound ``slack`` on the error by row of x."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        ok = np.isfinite(y).all(axis=1)
        mid = y[ok].mean(axis=0) if ok.any() else np.zeros(y.shape[1])
        with np.errstate(invalid="ignore", over="ignore"):
            u, v = x - mid, y - mid
            self.length = max((float(np.abs(z[np.isfinite(z)]).max(initial=0)) for z in (u, v)), default=0) or 1.0
            u, v = u / self.length, v / self.length
            nu, nv = (u * u).sum(axis=1), (v * v).sum(axis=1)
            most = nv[np.isfinite(nv)].max(initial=0)
            self.slack = 2 * (u.shape[1] + 8) * 2.0**-23 * (np.sqrt(nu) + np.sqrt(most)) ** 2 + 1e-30
            self.u = np.column_stack([-2 * u, np.ones(len(u)), nu]).astype(np.float32)
            self.v = np.column_stack([v, nv, np.ones(len(v))]).astype(np.float32)

    def steps(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, columns, squared distances), by columns."""
        columns = min(COLUMNS, max(1, len(self.v)))
        rows = max(1, min(PRODUCT_BYTES // (4 * columns), len(self.u)))
        room = np.empty(rows * columns, np.float32)  # written anew by each step, as pages of new arrays cost more than products
        for c in range(0, len(self.v), COLUMNS):
            v = self.v[c : c + COLUMNS]
            for r in range(0, len(self.u), rows):
                u = self.u[r : r + rows]
                with np.errstate(invalid="ignore", over="ignore"):
                    yield slice(r, r + len(u)), slice(c, c + len(v)), np.matmul(u, v.T, out=room[: len(u) * len(v)].reshape(len(u), len(v)))


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, from the differences, as by ``distances``."""
    step = max(1, STEP_BYTES // (8 * x.shape[1]))
    parts = [np.sqrt(((x[i[lo : lo + step]] - y[j[lo : lo + step]]) ** 2).sum(axis=1)) for lo in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _without_copies(y: np.ndarray, ids: np.ndarray, groups: np.ndarray, most: int) -> np.ndarray:
    """Which rows stay if of equal vectors of a group only the ``most`` with the least ids do."""
    bits = np.ascontiguousarray(y).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (bits * np.random.default_rng(0).integers(1, 2**63, bits.shape[1], dtype=np.uint64) * np.uint64(2) + bits).sum(axis=1)
    order = np.lexsort((ids, groups, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (groups[order][1:] != groups[order][:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    late = np.flatnonzero(np.arange(len(order)) - first >= most)
    keep = np.ones(len(y), bool)
    same = (bits[order[late]] == bits[order[late - most]]).all(axis=1) & (bits[order[late]] == bits[order[first[late]]]).all(axis=1)
    keep[order[late[same]]] = False
    return np.flatnonzero(keep)


def _best(q: dict, c: dict, k: int, group: str) -> pd.DataFrame:
    """Each query's k nearest rows of c (ties by id), of those within its ``reach``."""
    ids, times = np.unique(c["id"], return_counts=True)
    own = int(times.max(initial=0))
    stay = _without_copies(c["vec"], c["id"], c["grp"], k + own)
    x, y, mine, theirs, mg, tg = q["vec"], c["vec"][stay], q["id"], c["id"][stay], q["grp"], c["grp"][stay]
    dist, near = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
    reach = np.nan_to_num(q["reach"], nan=np.inf)
    screen = _Screen(x, y)
    for rows, columns, d in screen.steps():
        if group != "any":
            same = mg[rows, None] == tg[columns]
            d[same if group == "other" else ~same] = np.inf
        limit = np.minimum(dist[rows, -1], reach[rows])
        bound = (limit / screen.length) ** 2 * (1 + 1e-6) + screen.slack[rows]
        fresh = np.flatnonzero(np.isinf(limit))
        if len(fresh) and d.shape[1] > k - 1 + own:
            bound[fresh] = np.partition(d[fresh], k - 1 + own, axis=1)[:, k - 1 + own] * (1 + 1e-6) + 3 * screen.slack[rows][fresh]
        with np.errstate(invalid="ignore"):
            may = d <= bound[:, None].astype(np.float32)
        if np.isinf(bound).any():
            may &= np.isfinite(d)
        i, j = np.divmod(np.flatnonzero(may), d.shape[1])
        i, j = i + rows.start, j + columns.start
        told = mine[i] != theirs[j]
        i, j = i[told], j[told]
        exact = _exact(x, y, i, j)
        told = np.isfinite(exact) & (exact <= reach[i])
        _merge(dist, near, i[told], theirs[j[told]], exact[told])
    i, j = np.nonzero(np.isfinite(dist))
    return pd.DataFrame({"q_id": mine[i], "c_id": near[i, j], "dist": dist[i, j]})


def _merge(dist: np.ndarray, near: np.ndarray, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
    """Put the candidates (row i, id, distance) among the best of their rows."""
    rows, k = np.unique(i), dist.shape[1]
    i, ids, d = np.concatenate([i, np.repeat(rows, k)]), np.concatenate([ids, near[rows].ravel()]), np.concatenate([d, dist[rows].ravel()])
    order = np.lexsort((ids, d, i))
    i, ids, d = i[order], ids[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    kept = rank < k
    dist[i[kept], rank[kept]], near[i[kept], rank[kept]] = d[kept], ids[kept]


class _Cells:
    """Vectors dealt to the nearest of some pivots: the cells' radii bound what lies in them from below, without looking at it."""

    def __init__(self, corpus: DataFrame, n: int, width: int) -> None:
        self.width, self.rows = width, max(1, min(max(BLOCK, n // 16), _fits(width)))
        wanted = 1 if n <= self.rows else min(PIVOTS, max(1, PIVOT_BYTES // (8 * width)), 4 * -(-n // self.rows))
        picked = corpus.orderBy(F.xxhash64("id"), "id").select("vec").limit(wanted).toPandas()  # at most PIVOT_BYTES, or one row
        self.pivots = np.unique(_stacked(picked["vec"]), axis=0) if len(picked) else np.zeros((1, width))
        self.held = self.placed(corpus)
        stats = self.held.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).toPandas()  # a row for each pivot
        count = len(self.pivots)
        self.n, self.lo, self.hi = np.zeros(count, np.int64), np.full(count, np.inf), np.full(count, -np.inf)
        self.n[stats["cell"]], self.lo[stats["cell"]], self.hi[stats["cell"]] = stats["n"], stats["lo"], stats["hi"]

    def __getstate__(self) -> dict:
        return {n: v for n, v in self.__dict__.items() if n != "held"}  # tasks get the pivots, not the table

    def around(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots, from products: ``_slack`` bounds their error. Where these overflow, from the differences."""
        mid = self.pivots.mean(axis=0)
        p = self.pivots - mid
        out = np.zeros((len(x), len(p)))
        step = max(1, STEP_BYTES // (8 * (len(p) + x.shape[1])))
        for lo in range(0, len(x), step):
            with np.errstate(invalid="ignore", over="ignore"):
                u = x[lo : lo + step] - mid
                square = (u * u).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (u @ p.T)
            out[lo : lo + step] = np.sqrt(np.maximum(square, 0))
        bad = np.flatnonzero(~np.isfinite(out).all(axis=1))
        for lo, d in _steps(x[bad], self.pivots):
            out[bad[lo : lo + len(d)]] = d
        return out

    def _slack(self, d: np.ndarray) -> np.ndarray:
        """What sums of two such distances may be off by, for rows with the distances d: for the rows and for what lies in the cells."""
        span = np.abs(self.pivots - self.pivots.mean(axis=0)).max(initial=0) * self.width**0.5
        most = np.abs(self.hi[np.isfinite(self.hi)]).max(initial=0)
        return 2 * np.sqrt((self.width + 8) * 2.0**-51) * (d + 2 * most + 4 * span) + 1e-9

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` dealt, in a table, as they are read several times; by id first, as a file may be one row group, which is one task."""
        return stash(self.dealt(rows.repartition("id")), "dealt") if len(self.pivots) > 1 else self.dealt(rows)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the cell and the distance r to its pivot."""
        if len(self.pivots) == 1:  # nothing to prune
            return rows.withColumn("cell", F.lit(0)).withColumn("r", F.lit(0.0))
        around = self.around

        def deal(parts):
            for p in parts:
                d = around(_stacked(p["vec"])) if len(p) else np.zeros((0, 1))
                yield p.assign(cell=d.argmin(axis=1).astype("int32"), r=d.min(axis=1) if len(p) else [])

        return rows.mapInPandas(deal, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, cell int, r double")

    def grouped(self, counts: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """For each cell the first of the about ``blocks`` blocks that hold it, and how many these are; small cells share a block."""
        size = max(1, -(-int(counts.sum()) // blocks))
        first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size))
        block, room = 0, size
        for c, n in enumerate(counts):
            if n > room:
                block, room = block + (room < size), size
            first[c] = block
            block, room = (block + parts[c], size) if parts[c] > 1 else (block, room - n)
        return first, parts

    def home(self, k: int) -> list[np.ndarray]:
        """For each cell the nearest cells that hold more than k rows together, itself first."""
        order = np.argsort(self.around(self.pivots), axis=1, kind="stable")
        return [row[: int(np.searchsorted(np.cumsum(self.n[row]), k + 1)) + 1] for row in order]

    def needed(self, x: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """(rows, cells): where a row of x may have something within ``reach``, by the triangle inequality; the slack covers rounding."""
        d = self.around(x)
        with np.errstate(invalid="ignore"):
            return (np.maximum(d - self.hi, self.lo - d) <= reach[:, None] + self._slack(d)) & (self.n > 0)


def _searched(queries: DataFrame, corpus: DataFrame, k: int, group: str) -> tuple[DataFrame, int, int]:
    """(neighbours, visited pairs of a cell of queries and a cell of the corpus, all of them)."""
    spark = corpus.sparkSession
    _one_by_one(spark)
    named = [rows.select(*(F.col(c).alias(c) for c in ("id", "vec", "grp"))) for rows in (queries, corpus)]  # told apart even if they are one table
    first = named[1].select(F.size("vec").alias("w")).first()
    n = named[1].count()
    cells = _Cells(named[1], n, max(1, first["w"] if first else 1))
    held = cells.held
    asked = held.select("*") if queries is corpus else cells.placed(named[0])
    counted = np.zeros(len(cells.pivots), np.int64)
    for r in asked.groupBy("cell").count().collect():  # a row for each pivot
        counted[r["cell"]] = r["count"]
    q_blocks, c_blocks = _blocks((int(counted.sum()), n), (cells.width + 4, cells.width + 4), PAIRS)
    (q_first, q_parts), (c_first, c_parts) = cells.grouped(counted, q_blocks), cells.grouped(cells.n, c_blocks)

    def placed(rows: DataFrame, first: np.ndarray, parts: np.ndarray, name: str) -> DataFrame:
        at = lambda x: F.get(F.array(*map(F.lit, x.tolist())), "cell")
        return rows.withColumn(name, at(first).cast("bigint") + F.pmod(F.xxhash64("id"), at(parts)))

    held = placed(held.drop("r"), c_first, c_parts, "c_block")

    def near(rows: DataFrame, open_: np.ndarray) -> DataFrame:
        """The best of the corpus's cells that are open to a query's cell. A pair of blocks is one row."""
        a = placed(rows.drop("r"), q_first, q_parts, "q_block")
        pairs = {(int(q), int(c)) for i, j in zip(*np.nonzero(open_), strict=True) if counted[i] for q in range(q_first[i], q_first[i] + q_parts[i]) for c in range(c_first[j], c_first[j] + c_parts[j])}
        met = spark.createDataFrame(sorted(pairs), "q_block bigint, c_block bigint")  # blocks, bounded by the cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    q, c = ({n: _values(batch.column(f"{side}_{n}"), r) for n in ("id", "vec", "grp", "cell", "reach") if (side, n) != ("c", "reach")} for side in "qc")
                    q["vec"], c["vec"] = q["vec"].reshape(len(q["id"]), -1), c["vec"].reshape(len(c["id"]), -1)
                    there = np.unique(c["cell"])
                    ways, which = np.unique(open_[np.ix_(q["cell"], there)], axis=0, return_inverse=True)
                    for w, way in enumerate(ways):
                        mine, theirs = np.flatnonzero(which.ravel() == w), np.flatnonzero(np.isin(c["cell"], there[way]))
                        if len(theirs):
                            yield pa.RecordBatch.from_pandas(_best({n: v[mine] for n, v in q.items()}, {n: v[theirs] for n, v in c.items()}, k, group), preserve_index=False)

        q = _packed(a, "q_block").withColumnsRenamed({n: f"q_{n}" for n in ("id", "vec", "grp", "cell", "reach")})
        c = _packed(held, "c_block").withColumnsRenamed({n: f"c_{n}" for n in ("id", "vec", "grp", "cell")})
        key = ["q_block", "c_block"]
        return q.join(met, "q_block").join(c.join(met, "c_block"), key).mapInArrow(run, "q_id bigint, c_id bigint, dist double")

    count = len(cells.pivots)
    seen = np.zeros((count, count), bool)
    for i, row in enumerate(cells.home(k)):
        seen[i, row] = counted[i] > 0
    seen &= cells.n > 0
    order = Window.partitionBy("q_id").orderBy("dist", "c_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    anywhere = (counted > 0)[:, None] & (cells.n > 0)
    if (seen == anywhere).all():
        return top(near(asked.withColumn("reach", F.lit(None).cast("double")), seen)), int(seen.sum()), int(anywhere.sum())
    found = stash(top(near(asked.withColumn("reach", F.lit(None).cast("double")), seen)).drop("rank"), "near")
    reach = found.groupBy("q_id").agg(F.when(F.count("*") >= k, F.max("dist")).alias("reach"))
    needed = cells.needed

    def open_cells(parts):
        for p in parts:
            if len(p):
                vec, far = _stacked(p["vec"]), p["reach"].fillna(np.inf).to_numpy(float)
                step = max(1, STEP_BYTES // (8 * count))
                own = [np.column_stack([p["cell"].to_numpy()[lo + i], cell]) for lo in range(0, len(p), step) for i, cell in [np.nonzero(needed(vec[lo : lo + step], far[lo : lo + step]))]]
                out = np.unique(np.concatenate(own), axis=0)
                yield pd.DataFrame({"cell": out[:, 0], "other": out[:, 1]})

    told = asked.join(reach, asked["id"] == reach["q_id"], "left").drop("q_id")
    more = np.zeros((count, count), bool)
    for r in told.mapInPandas(open_cells, "cell int, other int").distinct().collect():  # at most the square of the pivots
        more[r["cell"], r["other"]] = True
    more &= ~seen
    both = found.unionByName(near(told, more)) if more.any() else found
    return top(both), int((seen | more).sum()), int(anywhere.sum())


def neighbours(queries: DataFrame, corpus: DataFrame, k: int, group: str = "any") -> DataFrame:
    """(q_id, c_id, dist, rank): the k nearest rows of the corpus by Euclidean distance (ties by id), the query
    itself left out; with group "other" or "own", only rows of other groups or of its own. Both sides are (id, vec, grp).

    Exact. The corpus is dealt to cells around pivots. Each block of queries first meets the cells around its own, which bounds
    each query's reach; after that it meets only the cells that the triangle inequality leaves within the reach of one of its
    queries, all of them where a query has found fewer than k.
    """
    return _searched(queries, corpus, k, group)[0]


def visited(queries: DataFrame, corpus: DataFrame, k: int, group: str = "any") -> DataFrame:
    """(visited, blocks): how many pairs of cells ``neighbours`` works on, and how many there would be without pruning."""
    return queries.sparkSession.createDataFrame([_searched(queries, corpus, k, group)[1:]], "visited bigint, blocks bigint")


def gram_distances(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(a, b, dist): Euclidean distances from inner products, sqrt(x.x + y.y - 2 x.y), never below 0 and 0 from a row to itself. All pairs of
    the two sides, in blocks, of which STEP_BYTES of results are made at a time: ``queries`` is meant to be a stated set of rows."""
    left = queries.select(F.col("id").alias("l_id"), F.col("vec").alias("lv"))
    right = corpus.select(F.col("id").alias("r_id"), F.col("vec").alias("rv"))

    def all_of(q: dict, c: dict, same: bool) -> Iterator[pd.DataFrame]:
        y, step = c["rv"], max(1, STEP_BYTES // (64 * len(c["r_id"])))
        for lo in range(0, len(q["l_id"]), step):
            x = q["lv"][lo : lo + step]
            square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
            one, two = np.repeat(q["l_id"][lo : lo + step], len(y)), np.tile(c["r_id"], len(x))
            yield pd.DataFrame({"a": one, "b": two, "dist": np.where(one == two, 0.0, np.sqrt(np.maximum(square, 0)).ravel())})

    return _met(left, right, all_of, "a bigint, b bigint, dist double")


def _near(rows: DataFrame, threshold: float, told: Callable, schema: str) -> DataFrame:
    """What ``told`` makes of (ids, ids, places i, places j, cosines) of the pairs above the threshold, a step of a pair of blocks at a time."""
    unit_rows = rows.select("id", unit(F.col("vec")).alias("u"))
    left = unit_rows.select(F.col("id").alias("l_id"), F.col("u").alias("lv"))
    right = unit_rows.select(F.col("id").alias("r_id"), F.col("u").alias("rv"))

    def close(x: dict, y: dict, same: bool) -> Iterator[pd.DataFrame]:
        step = max(1, STEP_BYTES // (8 * len(y["r_id"])))
        for lo in range(0, len(x["l_id"]), step):
            r = x["lv"][lo : lo + step] @ y["rv"].T
            i, j = np.divmod(np.flatnonzero(r > threshold), r.shape[1])
            yield told(x["l_id"][lo + i], y["r_id"][j], r[i, j], same)

    return _met(left, right, close, schema, half=True)


def near_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, r): pairs a < b of (id, vec) whose centred cosine is above the threshold."""

    def told(p: np.ndarray, q: np.ndarray, r: np.ndarray, same: bool) -> pd.DataFrame:
        kept = p < q if same else p != q  # within a block a pair is met twice
        return pd.DataFrame({"a": np.minimum(p, q)[kept], "b": np.maximum(p, q)[kept], "r": r[kept]})

    return _near(rows, threshold, told, "a bigint, b bigint, r double")


def near_earlier(rows: DataFrame, threshold: float) -> DataFrame:
    """(id): the rows with a row of a smaller id whose centred cosine with theirs is above the threshold. No pair leaves a task."""

    def told(p: np.ndarray, q: np.ndarray, r: np.ndarray, same: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": np.unique(np.maximum(p, q)[p != q])})

    return _near(rows, threshold, told, "id bigint").distinct()


def components_long(rows: DataFrame) -> DataFrame:
    """(id, grp, pos, x): a row for each component of each vector."""
    return rows.select("id", "grp", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


def prdc(real: DataFrame, fake: DataFrame, k: int) -> DataFrame:
    """precision, recall, density, coverage with k-nearest-neighbour radii and strict comparison."""
    def radii(rows: DataFrame) -> DataFrame:
        return neighbours(rows, rows, k).filter(F.col("rank") == k).select(F.col("q_id").alias("id"), F.col("dist").alias("radius"))

    def within(points: DataFrame, balls: DataFrame) -> DataFrame:
        """(kind, id, n): for points and for balls, how many of the other kind are inside or around them, by block."""
        held = stash(balls.join(radii(balls), "id"), "balls")  # read several times
        left = points.select(F.col("id").alias("l_id"), F.col("vec").alias("lv"))
        right = held.select(F.col("id").alias("r_id"), F.col("vec").alias("rv"), "radius")

        def inside(x: dict, y: dict, same: bool) -> Iterator[pd.DataFrame]:
            u, v, radius = x["lv"], y["rv"], y["radius"]
            screen = _Screen(u, v)
            limit = ((radius / screen.length) ** 2).astype(np.float32)
            points, balls = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
            for rows, columns, d in screen.steps():
                with np.errstate(invalid="ignore"):
                    slack = (screen.slack[rows].astype(np.float32) + np.float32(1e-6) * limit[columns].max(initial=0))[:, None]
                    d -= limit[columns]
                    within, maybe = d < -slack, np.flatnonzero(np.abs(d) <= slack)
                i, j = np.divmod(maybe, d.shape[1])
                ok = _exact(u, v, i + rows.start, j + columns.start) < radius[columns][j]
                points[rows] += np.count_nonzero(within, axis=1) + np.bincount(i[ok], minlength=len(d))
                balls[columns] += np.count_nonzero(within, axis=0) + np.bincount(j[ok], minlength=d.shape[1])
            out = pd.DataFrame({"kind": ["p"] * len(u) + ["b"] * len(v), "id": np.concatenate([x["l_id"], y["r_id"]]), "n": np.concatenate([points, balls])})
            yield out[out["n"] > 0]

        return _met(left, right, inside, "kind string, id bigint, n bigint")

    def counted(points: DataFrame, balls: DataFrame, names: dict[str, Column]) -> DataFrame:
        return within(points, balls).groupBy("kind", "id").agg(F.sum("n").alias("n")).agg(*(c.alias(x) for x, c in names.items()))

    points = F.col("kind") == "p"
    one = counted(fake, real, {"p": F.count_if(points), "d": F.sum(F.when(points, F.col("n")).otherwise(0)), "c": F.count_if(~points)})
    two = counted(real, fake, {"r": F.count_if(points)})
    n_real, n_fake = real.agg(F.count("*").alias("n_real")), fake.agg(F.count("*").alias("n_fake"))
    all_ = one.crossJoin(two).crossJoin(n_real).crossJoin(n_fake)  # one row each
    return all_.select((F.col("p") / F.col("n_fake")).alias("precision"), (F.col("r") / F.col("n_real")).alias("recall"), (F.col("d") / (k * F.col("n_fake"))).alias("density"), (F.col("c") / F.col("n_real")).alias("coverage"))


def intrinsic_dimension(rows: DataFrame, k: int) -> DataFrame:
    """(n, dim, status): 1 / mean over i of the mean over j < k of ln(T_k / T_j), from k-nearest-neighbour distances.
    Coincident points have no dimension of this kind: dim is then null and the status counts them."""
    near = neighbours(rows, rows, k)
    far = near.withColumn("t", F.max("dist").over(Window.partitionBy("q_id")))
    gain = F.when((F.col("rank") < k) & (F.col("dist") > 0), F.log(F.col("t") / F.col("dist"))).otherwise(0.0)
    each = far.groupBy("q_id").agg((F.sum(gain) / (k - 1)).alias("m"), F.bool_or(F.col("dist") == 0).alias("same"))
    bad = F.count_if("same")
    status = F.when(bad > 0, F.concat(F.lit("coincident points: "), bad.cast("string"))).otherwise("ok")
    return each.agg(F.count("*").alias("n"), F.when(bad == 0, 1 / F.avg("m")).alias("dim"), status.alias("status"))


def covariance(rows: DataFrame) -> DataFrame:
    """(i, j, c): the sample covariance of the components, from sums of products within each task."""
    def partial(parts):
        total, n = None, 0
        for p in parts:
            x = np.column_stack([np.ones(len(p)), np.stack(p["vec"]).astype(float)]) if len(p) else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel() - 1, "j": j.ravel() - 1, "s": total.ravel()})

    sums = rows.select("vec").mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    # Row and column -1 hold the sums of the components and the number of rows.
    n = sums.filter("i = -1 and j = -1").select(F.col("s").alias("n"))
    a = sums.filter("i >= 0 and j = -1").select("i", F.col("s").alias("si"))
    b = sums.filter("i = -1 and j >= 0").select("j", F.col("s").alias("sj"))
    out = sums.filter("i >= 0 and j >= 0").join(F.broadcast(a), "i").join(F.broadcast(b), "j").crossJoin(F.broadcast(n))  # dimension-sized sides
    return out.select("i", "j", ((F.col("s") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("c"))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and covariance matrix (dimension-sized) for eigen-decompositions on the driver."""
    mean = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").toPandas()
    cov = covariance(rows).toPandas().pivot(index="i", columns="j", values="c").to_numpy()
    return mean["m"].to_numpy(), cov


def frechet(a: DataFrame, b: DataFrame) -> float:
    """Squared Fréchet distance of two Gaussians fitted to the rows."""
    (ma, ca), (mb, cb) = moments(a), moments(b)
    w, v = np.linalg.eigh(ca)
    root = v * np.sqrt(np.maximum(w, 0)) @ v.T
    mixed = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ cb @ root), 0)).sum()
    return float(((ma - mb) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * mixed)


def principal_scores(rows: DataFrame, n: int) -> DataFrame:
    """(id, pc1..pcn): projections on the leading components; each one's largest loading is positive."""
    mean, cov = moments(rows)
    w, v = np.linalg.eigh(cov)
    v = v[:, np.argsort(-w)[:n]]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(n)])
    def score(axis: np.ndarray) -> Column:
        terms = F.zip_with("vec", F.array(*map(F.lit, axis.tolist())), lambda x, a: x.cast("double") * a)
        return F.aggregate(terms, F.lit(float(-(mean @ axis))), lambda s, x: s + x)

    return rows.select("id", *(score(v[:, k]).alias(f"pc{k + 1}") for k in range(n)))


def kernel_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n_a, n_b, distance): the unbiased squared kernel distance with the kernel (x.y / d + 1)**3 over all pairs."""

    def sums(one: DataFrame, two: DataFrame, name: str, same: bool) -> DataFrame:
        left = one.select(F.col("id").alias("l_id"), F.col("vec").alias("lv"))
        right = two.select(F.col("id").alias("r_id"), F.col("vec").alias("rv"))

        def total(p: dict, q: dict, twin: bool) -> Iterator[pd.DataFrame]:
            u, v, s = p["lv"], q["rv"], 0.0
            step = max(1, STEP_BYTES // (8 * len(v)))
            for lo in range(0, len(u), step):
                k = u[lo : lo + step] @ v.T / u.shape[1] + 1
                s += (k * k * k).sum()
            if same and twin:
                i, j = _equal(p["l_id"], q["r_id"])
                s -= (((u[i] * v[j]).sum(axis=1) / u.shape[1] + 1) ** 3).sum()
            yield pd.DataFrame({"s": [s if twin or not same else 2 * s]})  # of two blocks of one table, either order

        return _met(left, right, total, "s double", half=same).agg(F.sum("s").alias(name))

    n = a.agg(F.count("*").alias("n_a")).crossJoin(b.agg(F.count("*").alias("n_b")))  # one row each, as the sums
    all_ = n.crossJoin(sums(a, a, "aa", True)).crossJoin(sums(b, b, "bb", True)).crossJoin(sums(a, b, "ab", False))
    na, nb = F.col("n_a"), F.col("n_b")
    return all_.select("n_a", "n_b", (F.col("aa") / (na * (na - 1)) + F.col("bb") / (nb * (nb - 1)) - 2 * F.col("ab") / (na * nb)).alias("distance"))
