"""Tables in the shared folder."""

import os

import pytest
from millrace.plans.lineage import release, shared_folder, stash, temporary


def tables(spark):
    folder = shared_folder(spark)
    return {x for x in os.listdir(folder) if x.startswith("mine")} if os.path.isdir(folder) else set()


def test_tables_stay_until_released(spark):
    t = stash(spark.range(3), "mine")
    assert len(tables(spark)) == 1 and t.count() == 3
    release(t)
    assert not tables(spark)


def test_only_results_outlive_a_block(spark):
    with temporary(spark) as keep:
        one = stash(spark.range(5), "mine-a")
        with temporary(spark) as keep_inner:
            stash(spark.range(7), "mine-b")
            two = keep_inner(one.filter("id > 1"), "mine-c")
        assert {x[:6] for x in tables(spark)} == {"mine-a", "mine-c"}
        out = keep(two.filter("id > 2"), "mine-d")
    assert {x[:6] for x in tables(spark)} == {"mine-d"}
    assert out.count() == 2
    release(out)


def test_a_failed_block_leaves_nothing(spark):
    with pytest.raises(ZeroDivisionError), temporary(spark) as keep:
        keep(stash(spark.range(2), "mine"), "mine")
        stash(spark.range(2), "mine")
        raise ZeroDivisionError
    assert len(tables(spark)) == 1  # what was kept may be in someone's hands


def test_releasing_other_tables_does_nothing(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "own"))
    release(spark.read.parquet(str(tmp_path / "own")))
    assert os.path.isdir(tmp_path / "own")
