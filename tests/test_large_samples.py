"""Permutations, medians and gates on samples in many blocks: no row meets its draws in a join, and what the blocks tell completes the result."""

import hashlib

import numpy as np
import pytest
from millrace.functions.draws import draw, draws
from millrace.operators import resampling
from pyspark.sql import functions as F


def plans(df):
    return df._jdf.queryExecution().toString()


def test_draws_of_many_texts(spark):
    numbers, after = np.array([1, 9, 10, 99, 1234, 10_000]), np.array([b":7:a", b":12345:b", b"", b":" + b"x" * 60])
    got = draws("perm:g:", numbers, after)
    assert got.tolist() == [[int(hashlib.md5(b"perm:g:%d" % n + bytes(a)).hexdigest()[:8], 16) for a in after] for n in numbers]
    assert got[2, 0] == spark.range(1).select(draw("perm", F.lit("g"), 10, 7, F.lit("a"))).first()[0]


@pytest.mark.parametrize("deviations", [8, 0.5])
def test_permutation_in_blocks(spark, monkeypatch, deviations):
    """as by sorting every order, with blocks of seven rows; with a narrow range some orders are left to the sort."""
    for name, x in (("VALUES", 7), ("FEW", 3), ("DEVIATIONS", deviations)):
        monkeypatch.setattr(resampling, name, x)
    r = np.random.default_rng(1)
    rows = [(g, i, "ab"[i % 3 == 0], None if i == 4 else float(r.normal())) for g in ("u", None) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, id int, side string, value double")
    out = resampling.sampled_permutation(df, 20, ["g"])
    assert "WindowExec" not in plans(out) or deviations < 1
    got = {x["g"]: x for x in out.collect()}
    for g in ("u", None):
        own = [x for x in rows if x[0] == g]
        mean = lambda xs: float(np.mean([x[3] for x in xs if x[3] is not None]))
        a = [x for x in own if x[2] == "a"]
        observed, stats = mean(a) - mean([x for x in own if x[2] == "b"]), []
        for rep in range(1, 21):
            text = lambda x: ":".join(["perm", *([g] if g else []), str(rep), str(x[1]), x[2]])  # noqa: B023, E731
            order = sorted(own, key=lambda x: (hashlib.md5(text(x).encode()).hexdigest()[:8], x[1], x[2]))  # noqa: B023
            stats.append(mean(order[: len(a)]) - mean(order[len(a) :]))
        p = (1 + sum(abs(s) >= abs(observed) - 1e-9 for s in stats)) / 21
        assert got[g]["n_assignments"] == 20 and got[g]["observed"] == pytest.approx(observed) and got[g]["p_value"] == pytest.approx(p)


def test_permutation_of_equal_hashes(spark, monkeypatch):
    """Rows that are named alike have one hash in every order; all orders end outside the expected range."""
    monkeypatch.setattr(resampling, "FEW", 3)
    rows = [(1, "a", float(i)) for i in range(50)] + [(2, "b", float(i) + 1) for i in range(3000)]
    out = resampling.sampled_permutation(spark.createDataFrame(rows, "id int, side string, value double"), 6).first()
    assert out["n_assignments"] == 6 and 0 < out["p_value"] <= 1


@pytest.mark.parametrize("deviations", [8, 0.2])
def test_medians_in_blocks(spark, monkeypatch, deviations):
    """as by joining rows with their draws; nulls are drawn but do not count."""
    for name, x in (("VALUES", 7), ("FEW", 3), ("DEVIATIONS", deviations)):
        monkeypatch.setattr(resampling, name, x)
    r = np.random.default_rng(2)
    rows = [(g, i, None if i % 11 == 3 else round(float(r.normal()), 1)) for g, n in (("u", 61), (None, 40), ("w", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o int, x double")
    got = {(a["g"], a["rep"]): a["stat"] for a in resampling.resampled_medians(df, ["g"], "o", "x", 10).collect()}
    assert len(got) == 30
    for g in ("u", None, "w"):
        own = [x for x in rows if x[0] == g]
        seed = spark.range(1).select(draw("boot", F.lit(g).cast("string"))).first()[0]
        for rep in range(1, 11):
            at = resampling.positions(np.uint64(seed), np.uint64(rep), np.arange(len(own)), np.uint64(len(own)))
            assert got[g, rep] == pytest.approx(np.median([own[i][2] for i in at if own[i][2] is not None]))


def test_draws_are_not_rows_of_one_partition(spark):
    """the few rows that replicates are made of used to end up in one partition, which held all draws."""
    df = spark.createDataFrame([(i, float(i)) for i in range(40)], "o int, x double")
    assert resampling.replicates(df, [], "o", {"m": F.max("x")}, 4).count() == 4
    assert f"hashpartitioning(rep#" in plans(resampling.replicates(df, [], "o", {"m": F.max("x")}, 4)) and f"{resampling.SPREAD})" in plans(resampling.replicates(df, [], "o", {"m": F.max("x")}, 4))  # noqa: F541


def test_gate_in_blocks(spark, monkeypatch):
    """as by drawing units one by one; no plan explodes the draws."""
    for name, x in (("VALUES", 7), ("FEW", 3)):
        monkeypatch.setattr(resampling, name, x)
    r = np.random.default_rng(3)
    values = {(u, b): (float(r.normal()), 2 * float(r.normal())) for u in range(30) for b in "xy"}
    cells = spark.createDataFrame([(1, u, b, *v) for (u, b), v in values.items()], "part int, unit int, bin string, early double, late double")
    out = resampling.gate(cells, ["part"], spark.createDataFrame([("x", 1.0), ("y", 2.0)], "bin string, power double"), 10)
    assert "sequence(0, (cast(n#" not in plans(out)
    got, stats = out.first(), []
    for rep in range(11):
        at = [k if rep == 0 else int(hashlib.md5(f"gate:1:{rep}:{k}".encode()).hexdigest()[:8], 16) % 30 for k in range(30)]
        off = [np.sqrt(np.mean([(np.log10(np.var([values[i, b][side] for i in at])) - np.log10(p)) ** 2 for b, p in (("x", 1.0), ("y", 2.0))])) for side in (0, 1)]
        stats.append((*off, off[0] - off[1]))
    assert (got["n"], got["early"], got["late"], got["difference"]) == (30, *map(pytest.approx, stats[0]))
    assert (got["ci_low"], got["ci_high"]) == tuple(map(pytest.approx, np.quantile([s[2] for s in stats[1:]], [0.025, 0.975])))


def test_rows_that_are_not_finite_count_where_drawn():
    hits = np.array([[0, 2], [1, 1]])
    assert resampling._weighted(hits, np.array([[np.inf], [3.0]])).tolist() == [[6.0], [np.inf]]
