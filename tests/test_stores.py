"""Published tables, logs, CSV and files on small literal cases."""

import os

import pytest
from millrace.operators import curation, curves
from millrace.sources import stores
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def test_digest_tells_rows_not_their_order(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, 0.5), (2, None, 0.5)], "a int, b string, c double")
    assert stores.digest(a) == stores.digest(a.repartition(3).orderBy("a")) == stores.digest(a.select("c", "a", "b"))
    for other in (a.distinct(), a.limit(2), a.withColumn("a", F.col("a") + 1), a.withColumnRenamed("c", "d"), a.withColumn("a", F.col("a").cast("long")), a.fillna("", ["b"])):
        assert stores.digest(a) != stores.digest(other)
    # A null moves from one column to the next.
    b = [spark.createDataFrame([x], "a int, b int") for x in ((None, 1), (1, None))]
    assert stores.digest(b[0]) != stores.digest(b[1])
    maps = [spark.createDataFrame([(m,)], "m map<string,int>") for m in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2, "b": 1})]
    assert stores.digest(maps[0]) == stores.digest(maps[1]) != stores.digest(maps[2])


def test_cache(spark, tmp_path):
    folder, calls = str(tmp_path / "cache"), []

    def ask(rows, parameters=None):
        def work():
            calls.append(1)
            return rows.selectExpr("sum(id) AS s")

        return stores.load_or_compute(spark, folder, {"rows": rows}, parameters or {"p": 1}, work)

    first = ask(spark.range(5))
    assert first.computed and first.table.first()["s"] == 10
    again = ask(spark.range(5))
    assert not again.computed and again.key == first.key and again.table.first()["s"] == 10 and len(calls) == 1
    assert ask(spark.range(6)).computed and ask(spark.range(5), {"p": 2}).computed and len(calls) == 3
    # A table that does not agree with its sidecar is computed anew.
    spark.range(1).selectExpr("id + 99 AS s").write.mode("overwrite").parquet(f"{folder}/{first.key}/data")
    mended = ask(spark.range(5))
    assert mended.computed and mended.table.first()["s"] == 10
    os.remove(f"{folder}/{first.key}/{stores.SIDECAR}")
    assert ask(spark.range(5)).computed and not ask(spark.range(5)).computed
    assert not [x for x in os.listdir(folder) if x.startswith(".staged")]


def test_failed_computation_leaves_nothing_to_read(spark, tmp_path):
    folder = str(tmp_path / "cache")
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(PySparkException):
        stores.load_or_compute(spark, folder, {"rows": spark.range(3)}, {}, broken)
    assert stores.load_or_compute(spark, folder, {"rows": spark.range(3)}, {}, lambda: spark.range(3)).computed


def test_publish(spark, tmp_path):
    path = str(tmp_path / "table")
    checks = {"negative": lambda t: t.filter("x < 0"), "null": lambda t: t.filter("x is null")}
    put = lambda rows: stores.publish(spark.createDataFrame([(r,) for r in rows], "x int"), path, checks, ["null"])
    assert put([-1]) == stores.Published("INCOMPLETE", {"negative": 1}, False) and not os.path.exists(path)
    assert put([1, 2]) == stores.Published("COMPLETE", {}, True)
    assert put([None, -1, -2]) == stores.Published("FAIL", {"negative": 2, "null": 1}, False)
    assert spark.read.parquet(path).count() == 2
    assert put([7]).published and [r["x"] for r in spark.read.parquet(path).collect()] == [7]
    assert os.listdir(tmp_path) == ["table"]


def test_appended_batches_are_there_once(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.createDataFrame([(1, float("nan")), (2, float("-inf")), (3, 0.5), (4, None)], "a int, b double")
    assert [stores.append_batch(rows, path, i) for i in (0, 0, 1)] == [True, False, True]
    told = spark.read.schema("a int, b double, batch int").json(path).orderBy("batch", "a").collect()
    assert [(r["batch"], r["a"], r["b"]) for r in told] == [(k, a, 0.5 if a == 3 else None) for k in (0, 1) for a in (1, 2, 3, 4)]


def test_json_is_plain(spark):
    df = spark.createDataFrame([(123456.789, None, 3), (0.0, 1.23456789e-7, 4), (-0.00012345678, 1e300, 5)], "z double, a double, k int")
    assert [r["json"] for r in stores.plain_json(df).collect()] == ['{"a":null,"k":3,"z":123457.0}', '{"a":1.23457E-7,"k":4,"z":0.0}', '{"a":1.0E300,"k":5,"z":-1.23457E-4}']
    with pytest.raises(PySparkException, match="not a finite number"):
        stores.plain_json(spark.createDataFrame([(float("inf"),)], "x double")).collect()


def test_csv(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    stores.write_csv(spark.createDataFrame([("007", 1, True), ("8", None, False), ("8", 2, None)], "id string, n int, ok boolean").coalesce(1), path, ["ok", "id", "n"])
    (part,) = [x for x in os.listdir(path) if x.endswith(".csv")]
    assert open(f"{path}/{part}").read().splitlines() == ["ok,id,n", "true,007,1", "false,8,", ",8,2"]
    rows, problems = stores.read_csv(spark, path, "id string, n int, ok boolean", ["id", "n"], ["id"])
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted([("007", 1, True), ("8", None, False), ("8", 2, None)], key=repr)
    assert [tuple(r) for r in problems.collect()] == [("repeated key", "8", 2)]
    assert [tuple(r) for r in stores.read_csv(spark, path, "n int", ["n"], ["n"])[1].collect()] == [("null key", "", 1)]
    with pytest.raises(ValueError, match="no column step"):
        stores.read_csv(spark, path, "id string", ["id", "step"], ["id"])


@pytest.mark.parametrize(("text", "problem"), [('{"a":1}\n{"a"', "torn"), ('{"a"\n{"a":1}\n', "malformed"), ('{"a":1}\n{"a"\n\n \n', "torn"), ('{"a":1}\nNaN', "torn"), ('{"a":1}\n', None)])
def test_last_line_tolerance(spark, tmp_path, text, problem):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.jsonl").write_text(text)
    (tmp_path / "log" / "two.jsonl").write_text('{"a":2}\n')
    rows, problems = stores.read_log(spark, str(tmp_path / "log"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    assert [r["problem"] for r in problems.collect()] == ([problem] if problem else [])
    if problem == "malformed":
        with pytest.raises(ValueError, match="one.jsonl"):
            stores.strictly(rows, problems)
    else:
        assert stores.strictly(rows, problems).count() == 2


def test_last_line_of_a_file_in_many_blocks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"a":{i}}}\n' for i in range(5000)) + '{"a":')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, problems = stores.read_log(spark, str(tmp_path / "big.jsonl"), "a int")
        assert rows.count() == 5000 and [r["problem"] for r in problems.collect()] == ["torn"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_by_name(spark, tmp_path):
    for name in ("a/ckpt_100.pt", "a/b/ckpt_2000.PT", "a/ckpt_x.pt", "a/ckpt_5.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    found = stores.files(spark, str(tmp_path), r"ckpt_(\d+)\.\w+", {"step": "bigint"}, ("pt",)).orderBy("step").collect()
    assert [(r["step"], r["size"]) for r in found] == [(100, 5), (2000, 5)]


def test_accept_until(spark):
    rows = spark.range(1000).selectExpr("id", "id % 40 AS content")
    assert [r["id"] for r in curation.accept_until(rows, "id", F.col("id") % 2 == 1, F.col("content").cast("string"), 5).collect()] == [1, 3, 5, 7, 9]
    assert curation.accept_until(rows, "id", F.lit(True), F.col("content").cast("string"), 40).count() == 40
    with pytest.raises(ValueError, match="41 rows were asked for, and the whole table has 40"):
        curation.accept_until(rows, "id", F.lit(True), F.col("content").cast("string"), 41)
    with pytest.raises(ValueError):
        curation.accept_until(rows.limit(0), "id", F.lit(True), F.col("content").cast("string"), 1)


def test_abort_points(spark):
    logs = {"a": "..FF.FFF.FFFF", "b": "F.F.F.F.F.F", "c": "....", "d": "FF", "e": "F.F.FFF"}
    rows = [(g, i, x == "F") for g, log in logs.items() for i, x in enumerate(log)]
    found = curves.abort_points(spark.createDataFrame(rows, "g string, i int, bad boolean"), "g", "i", F.col("bad"), 3, 4).collect()
    assert sorted(map(tuple, found)) == [("a", 7, 5, 3, "3 failures in a row"), ("b", 8, 5, 1, "5 failures"), ("e", 6, 5, 3, "3 failures in a row")]
