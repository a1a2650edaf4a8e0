"""Bootstrap and permutations on small literal cases."""

import numpy as np
import pandas as pd
import pytest
from millrace.functions.draws import draw
from millrace.operators import resampling
from pyspark.sql import functions as F


def test_positions_as_expression(spark):
    rows = [(s, r, k, n) for s in (0, 4294967295, 123456789) for r in (1, 10_000) for k in (0, 77, 10**6) for n in (1, 7, 1000)]
    df = spark.createDataFrame(rows, "s bigint, r bigint, k bigint, n bigint")
    got = [x[0] for x in df.select(resampling.position(*map(F.col, "srkn"))).collect()]
    s, r, k, n = (np.array(c) for c in zip(*rows, strict=True))
    assert got == resampling.positions(s, r, k, n).tolist()


def test_positions_are_even():
    k = np.arange(200_000)
    hits = np.bincount(resampling.positions(np.uint64(99), np.uint64(3), k, np.uint64(50)), minlength=50)
    assert abs(hits - 4000).max() < 5 * np.sqrt(4000)


@pytest.mark.parametrize(("values", "replicates", "draws"), [(1 << 16, 500, 1 << 21), (7, 3, 10)])
def test_sums_as_joined_draws(spark, monkeypatch, values, replicates, draws):
    """Blocks of rows, of replicates and of draws of every size give the sums of the joined form; groups may be null."""
    for name, x in (("VALUES", values), ("REPLICATES", replicates), ("DRAWS", draws)):
        monkeypatch.setattr(resampling, name, x)
    rows = [("a" if i < 30 else None, i, float(i * i % 17), 1.0 + i % 3) for i in range(45)] + [("c", 1, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, o int, x double, y double")
    got = {(r["g"], r["rep"]): (r["n"], r["x"], r["y"]) for r in resampling.resampled_sums(df, ["g"], "o", ["x", "y"], 10).collect()}
    assert len(got) == 30
    for g in ("a", None, "c"):
        own = [r for r in rows if r[0] == g]
        seed = spark.range(1).select(draw("boot", F.lit(g).cast("string"))).first()[0]
        for rep in range(1, 11):
            at = resampling.positions(np.uint64(seed), np.uint64(rep), np.arange(len(own)), np.uint64(len(own)))
            assert got[g, rep] == (len(own), pytest.approx(sum(own[i][2] for i in at)), pytest.approx(sum(own[i][3] for i in at)))


def test_contrast(spark):
    values = [0.31, 0.44, 0.27, 0.52, 0.39, 0.41, 0.33, 0.48]
    df = spark.createDataFrame(list(enumerate(values)), "k int, delta double")
    r = resampling.contrast(df, [], "k", 2000).first()
    assert r["n"] == 8 and r["mean_delta"] == pytest.approx(np.mean(values)) and r["excludes_zero"]
    drawn = np.random.default_rng(0).choice(values, (20_000, 8)).mean(axis=1)
    assert r["ci_low"] == pytest.approx(np.quantile(drawn, 0.025), abs=0.01) and r["ci_high"] == pytest.approx(np.quantile(drawn, 0.975), abs=0.01)


def test_interval(spark):
    df = spark.createDataFrame(pd.DataFrame({"stat": [3.0, 1, 4, 1, 5, 9, 2, 6]}))
    assert tuple(resampling.interval(df, []).first()) == pytest.approx((1.0, 8.475))


def test_exact_permutation(spark):
    rows = [(i, s, v) for i, (s, v) in enumerate([("a", 0.10), ("a", 0.12), ("a", 0.11), ("b", 0.20), ("b", 0.22), ("b", 0.19)])]
    r = resampling.exact_permutation(spark.createDataFrame(rows, "id int, side string, value double")).first()
    assert (r["n_assignments"], r["p_value"], r["p_min"]) == (20, pytest.approx(0.1), pytest.approx(0.1))


def test_exact_permutation_has_a_bound(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(resampling.EXACT_BELOW)]
    with pytest.raises(ValueError, match="too many assignments"):
        resampling.exact_permutation(spark.createDataFrame(rows, "id int, side string, value double"))
