"""Sharding of documents by best-fit-decreasing bin packing, with equal texts kept together.

The rows of one text are one indivisible group. Groups, the largest first, enter the shard with the tightest room
that still takes them; rooms are kept in a balanced search tree. With a fixed ``capacity`` a shard is opened only
when no open one fits, so that there are few; with a fixed number of shards the least capacity is searched by
halving for which no more are needed, so that their sizes come out nearly equal.

Groups of one size are interchangeable, so the packing needs the sizes only: a *run* of equal groups enters a
shard at once, as many as it takes. What the driver holds is one row for each distinct size, of which there are at most
sqrt(2 * all bytes), however many rows there are; and a shard's room at least halves each time a run fills it, so the
plan has at most one entry for each size and 64 for each shard. The plan is a list of consecutive stretches of
all groups in order of size: groups are numbered by range partitions, and each looks up the stretch its number lies in.

Texts are read once, for their size and hashes; no text is shuffled. The rows join their groups' shards by hash;
groups that hold a thousandth of all rows or more (at most a thousand) go by broadcast instead, so no
key of the shuffle is hot. Slots are numbered by range partitions within the shards.

Edge cases: a null text counts as an empty one; groups larger than a shard's fair share get a shard of their own, and
the others share the rest evenly; with fewer groups than shards some shards stay empty; rows may repeat and ids
may be null (they come first within a shard); an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranking import numbered
from millrace.plans.lineage import stash

#: Bytes that every row counts for besides its text.
ROW_BYTES = 16
#: Groups with this share of all rows are hot.
HOT = 1000


@dataclass(slots=True)
class _Node:
    room: tuple[int, int]
    weight: int
    left: _Node | None = None
    right: _Node | None = None


def _split(node: _Node | None, least: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
    """The nodes below ``least`` and the others."""
    if node is None:
        return None, None
    if node.room < least:
        node.right, rest = _split(node.right, least)
        return node, rest
    rest, node.left = _split(node.left, least)
    return rest, node


def _merge(low: _Node | None, high: _Node | None) -> _Node | None:
    if low is None or high is None:
        return low or high
    if low.weight > high.weight:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high


class Rooms:
    """(room, shard) pairs in a search tree that random weights keep balanced: the shard with the tightest room is found in logarithmic time."""

    def __init__(self) -> None:
        self.root: _Node | None = None
        self.random = np.random.default_rng(1)

    def put(self, room: int, shard: int) -> None:
        low, high = _split(self.root, (room, shard))
        self.root = _merge(_merge(low, _Node((room, shard), int(self.random.integers(1 << 62)))), high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the least room of at least ``size``."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first.left is not None:
            first = first.left
        _, rest = _split(high, (first.room[0], first.room[1] + 1))
        self.root = _merge(low, rest)
        return first.room


def best_fit(runs: list[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[tuple[int, int]] | None:
    """Pack ``runs`` of (size, number of groups), the largest size first: (shard, number of groups) in the same order, with shards
    numbered from ``first``. None if more than ``most`` shards were needed. A group beyond the capacity gets a shard of its own."""
    rooms, out, shards = Rooms(), [], 0
    for size, left in runs:
        while left:
            found = rooms.tightest(size) if size <= capacity else None
            if found is None:
                if shards == most:
                    return None
                found = (max(capacity, size), first + shards)
                shards += 1
            room, shard = found
            n = min(left, room // size)
            left -= n
            out.append((shard, n))
            if room - n * size > 0:
                rooms.put(room - n * size, shard)
    return out


def even(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Pack ``runs`` into at most ``shards`` shards of nearly equal size."""
    total = sum(s * n for s, n in runs)
    own: list[tuple[int, int]] = []  # groups larger than what is a fair share of what is left
    rest = [list(r) for r in runs]
    while rest and shards - len(own) > 1 and rest[0][0] * (shards - len(own)) > total:
        own.append((len(own), 1))
        total -= rest[0][0]
        rest[0][1] -= 1
        if not rest[0][1]:
            rest.pop(0)
    if not rest:
        return own
    left, pairs = shards - len(own), [(s, n) for s, n in rest]
    low = max(-(-total // left), pairs[0][0])  # no capacity below it can do
    high = low
    while (plan := best_fit(pairs, high, left, len(own))) is None:
        high += max(1, high - low, low // 1_000_000)
    while low < high:
        middle = (low + high) // 2
        if (better := best_fit(pairs, middle, left, len(own))) is None:
            low = middle + 1
        else:
            high, plan = middle, better
    return own + plan


def _stretches(plan: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of the plan begins, and its shard."""
    shard, n = np.array(plan, np.int64).reshape(-1, 2).T
    return np.cumsum(n) - n, shard


def _looked_up(number, spark: SparkSession, plan: list[tuple[int, int]]):
    shared = spark.sparkContext.broadcast(_stretches(plan))

    def run(numbers: pa.Array) -> pa.Array:
        begin, shard = shared.value
        return pa.array(shard[np.searchsorted(begin, numbers.to_numpy(zero_copy_only=False), "right") - 1], pa.int32())

    return F.arrow_udf(run, "int").asNondeterministic()(number)


def packed(rows: DataFrame, group: list[str], size: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """``rows`` with ``shard``: rows that agree in the ``group`` columns (none of them null) stay together, each row counts for
    ``size`` (at least 1). One of ``shards`` (nearly equal sizes) and ``capacity`` (few shards) is given.
    ``rows`` is read twice: it should be cheap to read."""
    spark = rows.sparkSession
    groups = stash(rows.groupBy(*group).agg(F.sum(size).alias("all__"), F.count("*").alias("rows__")), "groups")
    runs = groups.groupBy("all__").agg(F.count("*").alias("n"), F.sum("rows__").alias("rows__")).toArrow().sort_by([("all__", "descending")])
    sizes = list(zip(runs["all__"].to_pylist(), runs["n"].to_pylist(), strict=True))
    if not sizes:
        return rows.withColumn("shard", F.lit(None).cast("int"))
    plan = even(sizes, shards) if capacity is None else best_fit(sizes, capacity)
    ordered = numbered(groups.withColumn("order__", -F.col("all__")), [], ["order__", *group])
    placed = stash(ordered.select(*group, "rows__", _looked_up(F.col("i"), spark, plan).alias("shard")), "placed")
    least = max(2, sum(runs["rows__"].to_pylist()) // HOT + 1)
    hot = placed.filter(F.col("rows__") >= least).select(*group, F.col("shard").alias("hot__"))  # fewer than HOT rows
    marked = rows.join(F.broadcast(hot), group, "left")
    cold = marked.filter("hot__ is null").drop("hot__").join(placed.filter(F.col("rows__") < least).drop("rows__"), group)
    return marked.filter("hot__ is not null").withColumnRenamed("hot__", "shard").unionByName(cold)


def shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: it goes with another law) of each row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + ROW_BYTES).cast("bigint")
    rows = stash(docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "sized")
    placed = packed(rows, ["text_hash", "size"], "size", shards)
    slots = numbered(placed, ["shard"], ["doc_id", "text_hash"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("i").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
