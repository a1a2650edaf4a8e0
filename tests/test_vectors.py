"""Neighbours by pruned blocks against all pairs."""

import numpy as np
import pytest
from millrace.operators import vectors

SCHEMA = "id bigint, vec array<double>, grp int"


def clustered(n, d=4, clusters=8, seed=0):
    r = np.random.default_rng(seed)
    centres = 50 * r.normal(size=(clusters, d))
    which = r.integers(0, clusters, n)
    x = np.round(centres[which] + r.normal(size=(n, d)), 3)
    x[n // 2 : n // 2 + 10] = x[n // 2]  # copies
    return [(i, x[i].tolist(), int(which[i]) % 3) for i in range(n)]


def brute(queries, corpus, k, group):
    out = []
    for i, x, g in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y, h in corpus if j != i and (group == "any" or (g == h) == (group == "own")))
        out += [(i, j, round(dist, 9), rank) for rank, (dist, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)


@pytest.mark.parametrize(("k", "group"), [(1, "any"), (5, "any"), (3, "other"), (3, "own"), (400, "any")])
def test_as_all_pairs(spark, small_blocks, k, group):
    rows = clustered(300)
    q = [r for r in rows if r[0] % 4 == 0] + [(1000, [1e6] * 4, 0), (1001, rows[0][1], 9)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    got = vectors.neighbours(spark.createDataFrame(q, SCHEMA), corpus, k, group).collect()
    assert sorted((r["q_id"], r["c_id"], round(r["dist"], 9), r["rank"]) for r in got) == brute(q, rows, k, group)


def test_far_blocks_are_not_visited(spark, small_blocks):
    rows = spark.createDataFrame(clustered(600), SCHEMA)
    told = vectors.visited(rows, rows, 3).first()
    assert told["blocks"] > 500 and told["visited"] < 0.4 * told["blocks"]


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert vectors.neighbours(one, one, 3).collect() == []
    assert vectors.neighbours(none, one, 3).collect() == []
    assert vectors.neighbours(one, none, 3).collect() == []


def test_memory_does_not_follow_the_width(monkeypatch):
    monkeypatch.setattr(vectors, "STEP_BYTES", 1 << 12)
    x, y = np.ones((40, 300)), np.zeros((3, 300))
    assert max(len(d) for _, d in vectors._steps(x, y)) == 1
    assert sum(len(d) for _, d in vectors._steps(x, y)) == 40
