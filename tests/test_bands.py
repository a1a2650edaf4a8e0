"""Square arrays: transforms, bands and windows on small literal cases and odd rows."""

import numpy as np
import pytest
from millrace.operators import bands
from pyspark.errors import PythonException
from pyspark.sql import functions as F

SCHEMA = "id int, vec array<double>"


def arrays(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), SCHEMA)


def one(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_no_heat_is_the_input(spark):
    x = np.random.default_rng(0).normal(size=(3, 16)).tolist()
    assert one(arrays(spark, [*x, None]), bands.low_pass(F.col("vec"), 4, 0.0)) == [*x, None]


def test_heat_keeps_the_mean_and_much_heat_leaves_nothing_else(spark):
    x = np.random.default_rng(1).normal(size=(2, 36))
    out = np.array(one(arrays(spark, x.tolist()), bands.low_pass(F.col("vec"), 6, 50.0)))
    assert np.allclose(out, x.mean(axis=1, keepdims=True))
    twice = bands.low_pass(bands.low_pass(F.col("vec"), 6, 3.0), 6, 4.0)  # widths add up as squares
    assert np.allclose(one(arrays(spark, x.tolist()), twice), one(arrays(spark, x.tolist()), bands.low_pass(F.col("vec"), 6, 5.0)))


def test_modes_come_back(spark):
    x = np.random.default_rng(2).normal(size=(5, 49)).tolist()
    assert np.allclose(one(arrays(spark, x), bands.synthesised(bands.modes(F.col("vec"), 7), 7)), x)


@pytest.mark.parametrize("side", [4, 6, 9, 16])
def test_parts_add_up(spark, side):
    x = np.random.default_rng(side).normal(size=(4, side * side))
    found = one(arrays(spark, [*x.tolist(), None]), bands.parts(F.col("vec"), side))
    assert found[-1] is None
    parts = np.array(found[:-1])
    assert parts.shape == (4, len(bands.octaves(side)) + 2, side * side)
    assert np.allclose(parts.sum(axis=1), x)
    assert np.allclose(parts[:, -2], x.mean(axis=1, keepdims=True))
    products = np.einsum("nax,nbx->nab", parts, parts)
    assert np.allclose(products, products * np.eye(parts.shape[1]))  # the parts are orthogonal


def test_windows(spark):
    def mask(*at):
        x = np.zeros((5, 5))
        for r, c in at:
            x[r, c] = 1.0
        return x.ravel().tolist()

    rows = [mask(), mask((2, 2)), mask((0, 0), (0, 3)), mask((4, 4), (3, 4)), mask((0, 1), (4, 1)), None]
    found = [r[0] and tuple(r[0]) for r in arrays(spark, rows).orderBy("id").select(bands.window(F.col("vec"), 5, 0.5)).collect()]
    assert found == [(0, 5, 0, 5), (2, 3, 2, 3), (0, 4, 0, 4), (3, 5, 3, 5), (0, 5, 0, 5), None]


def test_thumbnails(spark):
    x = np.arange(16.0).tolist()
    found = one(arrays(spark, [x, [3.0] * 16]), bands.thumbnail(F.col("vec"), 4, 2))
    mean = np.array([2.5, 4.5, 10.5, 12.5]) - 7.5
    assert np.allclose(found, [mean / np.sqrt((mean**2).sum()), np.zeros(4)])
    with pytest.raises(ValueError):
        bands.thumbnail(F.col("vec"), 4, 3)


@pytest.mark.parametrize("row", [[1.0] * 15, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")]])
def test_malformed_arrays_are_errors(spark, row):
    with pytest.raises(PythonException, match="expected arrays|not finite"):
        arrays(spark, [row]).select(bands.modes(F.col("vec"), 4)).collect()


@pytest.mark.parametrize("sigma", [-1.0, float("nan"), float("inf")])
def test_width_is_checked(sigma):
    with pytest.raises(ValueError):
        bands.damping(4, sigma)


def test_sums_by_group_in_small_steps(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(40, 9))
    rows = [(None if i % 7 == 0 else i % 3, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "grp int, vec array<double>").repartition(3)
    found = {r["grp"]: (r["n"], r["diversity"]) for r in bands.within_group(table, "vec", 3, "grp").collect()}
    for g in (None, 0, 1, 2):
        own = np.array([v for h, v in rows if h == g])
        assert found[g] == (len(own), pytest.approx(((own - own.mean(axis=0)) ** 2).sum() / len(own) / 8))


def test_samples_at_their_prior_inherit_all(spark):
    """Samples that are their damped seed have no residual; samples that have nothing of it have all of the power."""
    r = np.random.default_rng(6)
    seeds = [(k, r.normal(size=16).tolist()) for k in range(3)]
    kept = bands.damping(4, 1.5)
    samples = [(k, bands.inverse(bands.forward(np.array(v).reshape(1, 4, 4) - np.mean(v)) * kept).ravel().tolist()) for k, v in seeds for _ in range(2)]
    power = bands.mode_power(spark.createDataFrame(seeds, "key int, vec array<double>"), "vec", 4)
    frames = [spark.createDataFrame(x, "key int, vec array<double>") for x in (samples, seeds)]
    told = bands.inherited_shares(bands.inherited(*frames, power, 4, 1.5)).first()
    assert told["share_measured"] == pytest.approx(1) and 0 < told["share_predicted"] < 1
    none = bands.inherited_shares(bands.inherited(*frames, power.withColumn("power", F.lit(0.0)), 4, 1.5)).first()
    assert none["share_measured"] is None and none["share_predicted"] is None


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert none.select(bands.parts(F.col("vec"), 4)).collect() == []
    assert bands.mode_power(none, "vec", 4).collect() == []
