"""Best-fit-decreasing packing: against the rule taken group by group, and the shards of whole tables."""

import bisect
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import sharding
from millrace.llm.queries import QUERIES
from pyspark.sql import functions as F


def one_by_one(sizes, capacity):
    """Loads by shard, and the shard of each group, each placed on its own into the tightest room."""
    rooms, out, n = [], [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(rooms, (s, -1)) if s <= capacity else len(rooms)
        if k == len(rooms):
            room, shard, n = max(s, capacity), n, n + 1
        else:
            room, shard = rooms.pop(k)
        out.append(shard)
        if room > s:
            bisect.insort(rooms, (room - s, shard))
    return out


def runs_of(sizes):
    return [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=60), capacity=st.integers(1, 60))
def test_runs_as_one_by_one(sizes, capacity):
    plan = sharding.best_fit(runs_of(sizes), capacity)
    assert [shard for shard, n in plan for _ in range(n)] == one_by_one(sizes, capacity)


def loads_of(plan, runs):
    loads, sizes = defaultdict(int), iter([s for s, n in runs for _ in range(n)])
    for shard, n in plan:
        for _ in range(n):
            loads[shard] += next(sizes)
    return loads


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 2000), min_size=1, max_size=80), shards=st.integers(1, 9))
def test_even(sizes, shards):
    """No more shards than asked for; a shard above the mean by more than a group holds one group only."""
    runs = runs_of(sizes)
    loads = loads_of(sharding.even(runs, shards), runs)
    assert sum(loads.values()) == sum(sizes) and set(loads) <= set(range(shards))
    assert max(loads.values()) <= max(max(sizes), sum(sizes) / shards + max(sizes))


def test_plan_is_short():
    """A few entries for each size and shard, however many groups there are."""
    runs = [(s, 1_000_000) for s in range(500, 16, -1)]
    plan = sharding.even(runs, 40)
    assert len(plan) < len(runs) + 64 * 40
    loads = loads_of([(s, 1) for s, _ in plan], [(1, len(plan))])
    assert len(loads) == 40 and sum(n for _, n in plan) == sum(n for _, n in runs)


def check(rows, out, shards):
    """Rows are those of the table; equal texts share a shard; slots have no gap. Returns the shards' sizes."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(map(repr, ((r["doc_id"], r["size"], r["text_crc32"]) for r in out))) == sorted(map(repr, ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)))
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in out)
    slots, loads, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return loads


def test_table(spark):
    """Nulls, empty and long texts, repeated rows, null ids, clashing columns, a text that a third of the rows hold."""
    r = random.Random(3)
    texts = ["copy " * 20] * 200 + [None, "", "é" * 30, "long " * 300] + ["".join(r.choice("ab ") for _ in range(r.randint(1, 400))) for _ in range(400)]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3
    docs = spark.createDataFrame([(*x, 3, 4, 5, "s") for x in rows], "doc_id bigint, text string, size int, shard int, slot int, text_hash string").repartition(5)
    loads = check(rows, sharding.shards(docs, 6).collect(), 6)
    # The copies fill a shard of their own, the others are even but for what a gap may be.
    own = 203 * (100 + 16)
    rest = sorted(loads.values())
    assert own in rest and max(v for v in rest if v != own) - min(rest) <= 40
    assert sharding.shards(docs.limit(0), 6).collect() == []


def test_fixed_capacity(spark):
    r = random.Random(5)
    rows = [(i, r.randint(1, 300)) for i in range(500)] + [(1000, 5000)]
    out = sharding.packed(spark.createDataFrame(rows, "g bigint, size bigint"), ["g"], "size", capacity=1000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    want = one_by_one([s for _, s in rows], 1000)
    assert len(out) == len(set(want)) == -(-sum(s for _, s in rows[:-1]) // 1000) + 1
    assert sorted(x["s"] for x in out)[-2:] == [1000, 5000]


@pytest.mark.parametrize("name", ["op12_sharding"])
def test_query(spark, sf_dir, name):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    loads = check(rows, QUERIES[name](spark, sf_dir).collect(), 40)
    assert len(loads) == 40
