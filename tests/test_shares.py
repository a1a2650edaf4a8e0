"""Closed forms and synthetic spectra on literal cases."""

import pytest
from millrace.operators import shares
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_closed_forms(spark):
    n = lambda x: F.lit(x).cast("double")
    assert value(spark, shares.within_fraction(n(0.5), 3, n(8))) == 0.5
    assert value(spark, shares.within_share(n(0.5), n(5), 3, n(8))) == pytest.approx(1 - 1.25 * 0.5)
    assert value(spark, shares.bias_fraction(n(0.25), n(0.5), 3, n(8))) == 0.25
    assert value(spark, shares.bias_expected(n(0.2), n(0.1), n(4))) == pytest.approx(0.3)
    assert value(spark, shares.regeneration(n(0.4), n(0.2))) == pytest.approx(0.75)


def test_missing_values_give_null(spark):
    n, none = (lambda x: F.lit(x).cast("double")), F.lit(None).cast("double")
    for column in (
        shares.within_fraction(n(0.5), 3, n(0)),
        shares.within_fraction(none, 3, n(8)),
        shares.within_share(n(0.5), n(1), 3, n(8)),
        shares.bias_fraction(none, n(0.5), 3, n(8)),
        shares.bias_expected(n(0.2), n(0.1), n(0)),
        shares.regeneration(n(0.4), n(1)),
    ):
        assert value(spark, column) is None


def test_power_law(spark):
    found = {(r["i"], r["j"]): r["power"] for r in shares.power_law(spark, 6, 2.0, 7.0).collect()}
    assert len(found) == 36 and found[0, 0] == 0 and sum(found.values()) == pytest.approx(7)
    assert found[0, 2] == pytest.approx(found[0, 1] / 4) and found[3, 4] == pytest.approx(found[0, 5])


def test_grids(spark):
    for side, most in ((8, 96.0), (96, 96.0), (128, 64.0), (192, 96.0)):
        rows = shares.grid(spark, side).orderBy("bin").collect()
        assert len(rows) == 48 and rows[0]["lo"] == 0.5 and rows[-1]["hi"] == pytest.approx(most)
        assert all(a["hi"] == b["lo"] for a, b in zip(rows[:-1], rows[1:], strict=True)) and [r["is_last"] for r in rows] == [False] * 47 + [True]
    with pytest.raises(ValueError):
        shares.grid(spark, 1)
