"""Components of wide vectors, Fréchet and kernel distances and their bootstrap, against NumPy."""

import numpy as np
import pytest
from millrace.operators import lowrank, vectors
from pyspark.sql import functions as F

SCHEMA = "id bigint, vec array<double>"


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], SCHEMA).repartition(parts)


def low_rank(n, d, rank, noise=0.0, seed=0):
    r = np.random.default_rng(seed)
    scale = 10.0 * 0.6 ** np.arange(rank)
    return r.normal(size=(n, rank)) * scale @ np.linalg.qr(r.normal(size=(d, rank)))[0].T + noise * r.normal(size=(n, d)) + 3.0


@pytest.mark.parametrize(("d", "noise"), [(7, 1.0), (900, 0.0), (900, 0.01)])
def test_components(spark, d, noise):
    x = low_rank(60, d, 5, noise)
    found = lowrank.components(table(spark, x), 3)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(found.variance, s[:3] ** 2 / 59, rtol=1e-6)
    assert found.total == pytest.approx((s**2).sum() / 59) and found.n == 60
    assert found.axes.shape == (d, 3) and np.allclose(found.axes.T @ found.axes, np.eye(3))
    pivot = np.abs(found.axes).argmax(axis=0)
    assert (found.axes[pivot, range(3)] > 0).all()
    assert np.allclose(np.abs((found.axes * v[:3].T).sum(axis=0)), 1, atol=1e-5)
    scores = table(spark, x).select("id", found.scores(F.col("vec"), spark).alias("s")).orderBy("id").collect()
    assert np.allclose([r["s"] for r in scores], (x - x.mean(axis=0)) @ found.axes)


def test_rank_and_shares(spark):
    found = lowrank.components(table(spark, low_rank(50, 300, 4)), 10)
    assert found.rank() == 4
    part = np.cumsum(found.variance) / found.total
    assert found.for_share(0.9) == int(np.argmax(part >= 0.9)) + 1 and found.for_share(1.0) == 4
    assert lowrank.components(table(spark, low_rank(50, 30, 20, 1.0)), 2).for_share(0.99) is None


def test_too_few_vectors(spark):
    with pytest.raises(ValueError, match="at least 4 vectors, not 3"):
        lowrank.components(table(spark, np.eye(3)), 3)
    with pytest.raises(ValueError):
        lowrank.components(spark.createDataFrame([], SCHEMA), 1)


def test_same_vectors_have_no_variance(spark):
    found = lowrank.components(table(spark, np.ones((5, 4))), 2)
    assert np.allclose(found.variance, 0) and found.rank() == 0 and found.for_share(0.5) is None


def frechet(x, y):
    a, b = np.cov(x.T), np.cov(y.T)
    w = np.linalg.eigvals(a @ b)
    return ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + np.trace(a + b) - 2 * np.sqrt(np.maximum(w.real, 0)).sum()


def kernel(x, y):
    k = lambda a, b: (a @ b.T / a.shape[1] + 1) ** 3
    n, m = len(x), len(y)
    return (k(x, x).sum() - np.trace(k(x, x))) / (n * (n - 1)) + (k(y, y).sum() - np.trace(k(y, y))) / (m * (m - 1)) - 2 * k(x, y).mean()


@pytest.fixture(scope="module")
def sides():
    r = np.random.default_rng(3)
    return r.normal(size=(40, 5)) @ np.diag([1, 2, 1, 0.5, 1]), r.normal(size=(55, 5)) + 0.3


def test_frechet(spark, sides):
    x, y = sides
    assert vectors.frechet(table(spark, x), table(spark, y)) == pytest.approx(frechet(x, y), rel=1e-8)
    assert vectors.frechet(table(spark, x), table(spark, x)) == pytest.approx(0, abs=1e-8)


@pytest.mark.parametrize("moment_bytes", [1 << 27, 700])
def test_bootstrap(spark, sides, monkeypatch, moment_bytes):
    """Every replicate from its own counts, whether all are made in one pass or a few at a time."""
    monkeypatch.setattr(lowrank, "MOMENT_BYTES", moment_bytes)
    x, y = sides
    counts = {r["id"]: r["w"] for r in lowrank.weighted(table(spark, x), 6).collect()}
    assert all(w[0] == 1 for w in counts.values())
    for made, want in ((lowrank.bootstrap_frechet, frechet), (lowrank.bootstrap_kernel, kernel)):
        found = {r["rep"]: r["distance"] for r in made(table(spark, x), table(spark, y), 6).collect()}
        assert set(found) == set(range(7))
        for rep in range(7):
            drawn = np.repeat(x, [counts[i][rep] for i in range(40)], axis=0)
            assert len(drawn) == 40 and found[rep] == pytest.approx(want(drawn, y), rel=1e-6)
    assert len({tuple(counts[i][r] for i in range(40)) for r in range(7)}) == 7


def test_kernel_subsets(spark, sides):
    x, y = sides
    whole = lowrank.kernel_subsets(table(spark, x), table(spark, x * 2), 3, 100).collect()
    assert [r["size"] for r in whole] == [40] * 3 and all(r["distance"] == pytest.approx(kernel(x, x * 2)) for r in whole)
    part = lowrank.kernel_subsets(table(spark, x), table(spark, y), 5, 10).collect()
    assert [r["size"] for r in part] == [10] * 5 and len({r["distance"] for r in part}) == 5
