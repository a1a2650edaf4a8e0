"""Pairs of blocks as rows: screening in single precision, copies, pieces of results, against plain NumPy."""

import numpy as np
import pytest
from millrace.operators import lowrank, vectors
from pyspark.sql import functions as F

SCHEMA = "id bigint, vec array<double>, grp int"


def frame(spark, x, groups=3):
    return spark.createDataFrame([(i, v, i % groups) for i, v in enumerate(x.tolist())], SCHEMA)


def all_distances(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize(("scale", "offset"), [(1, 0), (1, 1e6), (1e-30, 0), (1e200, 0), (0, 5)])
def test_screen_is_within_its_slack(scale, offset):
    r = np.random.default_rng(0)
    x, y = (scale * r.normal(size=(n, 9)) + offset for n in (70, 5000))
    screen = vectors._Screen(x, y)
    for rows, columns, d in screen.steps():
        want = ((x[rows, None] / screen.length - y[None, columns] / screen.length) ** 2).sum(axis=2)
        assert (np.abs(d - want) <= screen.slack[rows, None]).all()


@pytest.mark.parametrize("group", ["any", "other", "own"])
def test_neighbours_among_copies(spark, monkeypatch, group):
    """Many copies, of which those with the least ids are found; in many blocks and in steps of few columns."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(260, 3)), 2)
    x[r.permutation(260)[:150]] = x[0]
    got = {(a["q_id"], a["rank"]): (a["c_id"], a["dist"]) for a in vectors.neighbours(frame(spark, x), frame(spark, x), 4, group).collect()}
    d = all_distances(x, x)
    for i in range(260):
        ok = [j for j in range(260) if j != i and (group == "any" or (i % 3 == j % 3) == (group == "own"))]
        for rank, j in enumerate(sorted(ok, key=lambda j: (d[i, j], j))[:4], 1):  # noqa: B023
            assert got[i, rank] == (j, pytest.approx(d[i, j], abs=1e-12))


def test_blocks_are_rows(spark, monkeypatch):
    """Vectors used to be sent one by one to each pair of blocks, as often as the other side has blocks."""
    monkeypatch.setattr(vectors, "BLOCK", 10)
    rows = frame(spark, np.random.default_rng(2).normal(size=(100, 4)))
    for df in (vectors.near_pairs(rows, 0.9), vectors.neighbours(rows, rows, 2), vectors.gram_distances(rows, rows)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "FlatMapGroupsInArrow" in df._jdf.queryExecution().optimizedPlan().toString()


def test_near_earlier(spark, monkeypatch):
    """the screen asks for no pair; copies would make the square of their number."""
    monkeypatch.setattr(vectors, "BLOCK", 10)
    x = np.random.default_rng(3).normal(size=(90, 3))
    x[20:60] = x[5]
    rows = frame(spark, x)
    pairs = vectors.near_pairs(rows, 0.9).collect()
    c = x - x.mean(axis=1, keepdims=True)
    c /= np.sqrt((c * c).sum(axis=1, keepdims=True))
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(c @ c.T > 0.9, 1)), strict=True)}
    assert len(pairs) == len(want) and {(p["a"], p["b"]) for p in pairs} == want
    assert sorted(r["id"] for r in vectors.near_earlier(rows, 0.9).collect()) == sorted({b for _, b in want})


def test_prdc_in_blocks(spark, monkeypatch):
    """strict comparison with radii, also where distances are equal."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    r = np.random.default_rng(4)
    x, y = (np.round(r.normal(size=(n, 2)), 1) for n in (80, 70))
    radius = lambda z: np.sort(all_distances(z, z) + np.diag(np.full(len(z), np.inf)), axis=1)[:, 2]
    d = all_distances(y, x)
    a, b = d < radius(x), d.T < radius(y)
    got = vectors.prdc(frame(spark, x), frame(spark, y), 3).first()
    assert tuple(got) == pytest.approx((a.any(axis=1).mean(), b.any(axis=1).mean(), a.sum() / (3 * 70), a.any(axis=0).mean()))


def test_unit_vectors(spark):
    """one pass over a vector; it used to be gone through once for each of its values. Flat vectors have no direction."""
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, None), (2, [4.0, 4.0]), (3, [-1.0, 1.0])], "id int, v array<double>")
    out = [r[0] for r in df.select(vectors.unit(F.col("v"))).collect()]
    assert out[0] == pytest.approx([-(0.5**0.5), 0, 0.5**0.5]) and out[1] is None and np.isnan(out[2]).all() and out[3] == pytest.approx([-(0.5**0.5), 0.5**0.5])


def test_gram_distances_in_pieces(spark, monkeypatch):
    """F16: a task makes a bounded number of results at a time."""
    monkeypatch.setattr(vectors, "STEP_BYTES", 64 * 50)
    x = np.random.default_rng(5).normal(size=(40, 3))
    got = {(r["a"], r["b"]): r["dist"] for r in vectors.gram_distances(frame(spark, x).filter("id < 9"), frame(spark, x)).collect()}
    assert len(got) == 360 and all(d == pytest.approx(float(np.linalg.norm(x[a] - x[b])), abs=1e-7) for (a, b), d in got.items()) and got[3, 3] == 0


@pytest.mark.parametrize(("few", "many", "copies"), [(100, 10_000, 1), (1_000, 100_000, 1), (6_000, 600_000, 1), (60_000, 600_000, 3), (600_000, 600_000, 20)])
def test_the_larger_side_is_seldom_sent(few, many, copies):
    """a side is sent to each block of the other. Queries used to be cut into up to 16 blocks, whatever their number, so the corpus was sent 16 times."""
    a, b = vectors._blocks((few, many), (64, 64), vectors.PAIRS)
    assert a <= copies and (a * b >= min(vectors.PAIRS, many // vectors.BLOCK)) and -(-few // a) <= vectors._fits(64) and -(-many // b) <= vectors._fits(64)
    assert vectors._blocks((many, few), (64, 64), vectors.PAIRS) == (b, a) or few == many


def test_vectors_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch, request):
    """the rows of a file of one row group were dealt to cells by one task, anew for each use."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    monkeypatch.setattr(vectors, "BLOCK", 64)
    x = np.random.default_rng(5).normal(size=(700, 6))
    x[3], x[5] = 1e200, x[4]
    frame(spark, x).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    cells = vectors._Cells(rows.select("id", "vec", F.lit(0).alias("grp")), 700, 6)
    assert len(cells.pivots) > 1 and len(cells.held.inputFiles()) > 1
    assert np.allclose(cells.around(x), vectors.distances(x, cells.pivots), atol=1e-6)
    got = {(r["q_id"], r["rank"]): r["dist"] for r in vectors.neighbours(rows, rows, 3).collect()}
    d = vectors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    assert all(got[i, k + 1] == want[i, k] for i in range(700) for k in range(3) if np.isfinite(want[i, k]))


def test_pairs_come_few_at_once_and_counts_are_narrow(spark):
    """Python got 64 MB of pairs of blocks at once; a row's counts took 32 bits each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "67108864b")
        rows = frame(spark, np.eye(4))
        assert vectors.gram_distances(rows, rows).count() == 16
        assert int(spark.conf.get(name)) <= 1 << 20
    finally:
        spark.conf.set(name, before)
    assert lowrank.weighted(rows, 3).schema["w"].dataType.simpleString() == "array<smallint>"
