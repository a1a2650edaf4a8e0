"""Registered queries that publish tables and read logs, each next to its SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import curation, curves
from millrace.sources import stores
from millrace.sources.tables import read_table

from .catalog import _rounded
from .lineage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "WITH p AS (SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL) "
    "SELECT l_suppkey, n, quantity, true AS first_computed, false AS again_computed, true AS changed_computed, false AS first_again FROM p"
)
def cached_profile(spark, d):
    """A profile that is computed once for its input: asked for a second time it is read, and with changed rows it is computed anew, beside the first."""
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_orderkey")
    folder = _place(spark, "cache")

    def ask(rows: DataFrame) -> stores.Cached:
        work = lambda: rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
        return stores.load_or_compute(spark, folder, {"lineitem": rows}, {"by": "l_suppkey"}, work)

    changed = li.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    told = {"first_computed": ask(li), "again_computed": ask(li), "changed_computed": ask(changed), "first_again": ask(li)}
    return _rounded(told["again_computed"].table.select("l_suppkey", "n", "quantity", *(F.lit(x.computed).alias(c) for c, x in told.items())))


@query(
    "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total, 'COMPLETE' AS first, 'INCOMPLETE' AS second, 'FAIL' AS third, true AS stays FROM orders GROUP BY ALL"
)
def published_orders(spark, d):
    """A table that is published behind checks: a first one that passes, then two with planted rows that don't and leave it as it is."""
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    checks = {
        "no_price": lambda t: t.filter("o_totalprice is null or o_totalprice <= 0"),
        "repeated_key": lambda t: t.groupBy("o_orderkey").count().filter("count > 1"),
    }
    path = _place(spark, "orders")
    spoiled = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, -1.0).otherwise(F.col("o_totalprice")))
    told = [stores.publish(t, path, checks, ["repeated_key"]) for t in (orders, spoiled, orders.unionAll(orders.filter("o_orderkey % 50 = 0")))]
    stays = [x.published for x in told] == [True, False, False]
    out = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return _rounded(out.select("*", *(F.lit(x.verdict).alias(c) for c, x in zip(("first", "second", "third"), told, strict=True)), F.lit(stays).alias("stays")))


@query(
    "WITH b AS (SELECT *, CASE WHEN event_id % 7 = 0 AND event_type = 'view' THEN NULL ELSE value END AS v, event_id % 4 AS batch FROM events) "
    "SELECT batch, count(*) AS n, count(*) FILTER (v IS NULL) AS n_null, round(sum(v), 6) AS total FROM b GROUP BY ALL"
)
def appended_batches(spark, d):
    """Batches of JSON lines, each delivered twice and there once; numbers that are not finite are nulls."""
    e = read_table(spark, d, "events")
    value = F.when((F.col("event_id") % 7 == 0) & (F.col("event_type") == "view"), F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("value"))
    e = e.select("event_id", (F.col("event_id") % 4).alias("batch_no"), value.alias("v"))
    path = _place(spark, "lines")
    for _ in range(2):
        for b in range(4):
            stores.append_batch(e.filter(F.col("batch_no") == b).drop("batch_no"), path, b)
    lines = spark.read.schema("event_id bigint, v double, batch bigint").json(path)
    return _rounded(lines.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.sum("v").alias("total")))


_LOGS = (
    "e AS (SELECT event_id, event_type, value, user_id % 16 AS log, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id DESC) AS last, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS first FROM events), "
    "k AS (SELECT *, CASE WHEN log % 2 = 0 AND last = 1 THEN 'torn' WHEN log % 3 = 0 AND first = 1 AND last > 1 THEN 'malformed' END AS problem FROM e)"
)


@query(f"WITH {_LOGS} SELECT log, count(*) FILTER (problem IS NULL) AS n, round(sum(value) FILTER (problem IS NULL), 6) AS total, count(*) FILTER (problem = 'torn') AS n_torn, count(*) FILTER (problem = 'malformed') AS n_malformed FROM k GROUP BY log")
def log_lines(spark, d):
    """Logs of JSON lines, of which some end in a torn line, which is let pass, and some have one elsewhere, which is a problem."""
    e = read_table(spark, d, "events").select("event_id", "event_type", "value", (F.col("user_id") % 16).alias("log"))
    ends = e.groupBy("log").agg(F.min("event_id").alias("least"), F.max("event_id").alias("most"))
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    cut = ((F.col("log") % 2 == 0) & (F.col("event_id") == F.col("most"))) | ((F.col("log") % 3 == 0) & (F.col("event_id") == F.col("least")))
    written = e.join(F.broadcast(ends), "log").select("log", "event_id", F.when(cut, F.substring(line, 1, 12)).otherwise(line).alias("value"))  # a row for each log
    path = _place(spark, "logs")
    written.repartition("log").sortWithinPartitions("log", "event_id").select("log", "value").write.partitionBy("log").text(path)
    rows, problems = stores.read_log(spark, path, "event_id bigint, event_type string, value double")
    log = F.regexp_extract("file", r"/log=(\d+)/", 1).cast("bigint").alias("log")
    good = rows.groupBy(log).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    bad = problems.groupBy(log).agg(*(F.count_if(F.col("problem") == k).alias(f"n_{k}") for k in ("torn", "malformed")))
    return _rounded(good.join(bad, "log", "full_outer").select("log", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n",)), "total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_torn", "n_malformed"))))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars >= 200 GROUP BY sha256(text) ORDER BY 1 LIMIT 60")
def accept_until_n(spark, d):
    """The first 60 documents that pass, from as short a beginning of the table as will do."""
    return curation.accept_until(read_table(spark, d, "documents"), "doc_id", F.col("n_chars") >= 200, F.col("text"), 60)


@query(
    "WITH m AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "r AS (SELECT *, count(*) FILTER (bad) OVER w AS n_failed, place - coalesce(max(place) FILTER (NOT bad) OVER w, 0) AS in_a_row FROM m WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM r WHERE bad AND (in_a_row >= 3 OR n_failed > 12)) "
    "SELECT user_id, event_id, n_failed, in_a_row, CASE WHEN in_a_row >= 3 THEN in_a_row || ' failures in a row' ELSE n_failed || ' failures' END AS reason FROM s WHERE k = 1"
)
def abort_decisions(spark, d):
    """For each user the event at which failures in a row or in all pass a limit."""
    return curves.abort_points(read_table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error", 3, 12)


@query(
    "SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 AS even, false AS problem FROM nation UNION ALL "
    "SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 AS even, true AS problem FROM nation WHERE n_nationkey % 5 = 0"
)
def keyed_csv(spark, d):
    """A CSV written with named columns and read by name with pinned types; rows whose key is there twice are found."""
    n = read_table(spark, d, "nation").withColumn("even", F.col("n_nationkey") % 2 == 0)
    path = _place(spark, "csv")
    stores.write_csv(n.unionAll(n.filter("n_nationkey % 5 = 0")), path, ["even", "n_name", "n_nationkey", "n_regionkey"])
    rows, problems = stores.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int, even boolean", ["n_nationkey", "n_name"], ["n_nationkey"])
    bad = problems.select(F.col("key").cast("int").alias("n_nationkey"))
    return rows.distinct().withColumn("problem", F.lit(False)).unionByName(rows.distinct().join(bad, "n_nationkey", "left_semi").withColumn("problem", F.lit(True)))


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def named_files(spark, d):
    """Files found at any depth by their names, which tell what they hold; others are passed over."""
    li = read_table(spark, d, "lineitem")
    path = _place(spark, "files")
    told = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    told.select(F.concat_ws("-", F.lit("run"), "l_returnflag", "l_linestatus", F.col("n")).alias("run"), F.lit("x").alias("value")).write.partitionBy("run").text(path)
    found = stores.files(spark, path, r"part-.*\.txt", {}, ("txt",))
    return found.select(*(F.regexp_extract("path", r"run=run-(\w+)-(\w+)-(\d+)/", i).alias(c) for i, c in ((1, "flag"), (2, "status"), (3, "n")))).select("flag", "status", F.col("n").cast("bigint").alias("n"))
