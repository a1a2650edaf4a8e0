"""More registered queries: gates, contracts and verdicts, readers that don't give up, orders and picks, spectra, scalar forms.

Each query stands next to its SQL for DuckDB. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.draws import draw, r6
from millrace.operators import contracts, curves, ranking, resampling, spectra, tables, vectors
from millrace.sources.tables import read_table

from .catalog import ARMS, N_BOOT, N_GATE, N_PERM, _cells, _daily, _last_view, _power, _rounded, _vectors
from .oracles import _BASIS, _CELLS, _DAILY, _LONG, _PAIRS, _VEC, _boot, _draw, _nn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = ""):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _q(text: str) -> str:
    return f"'{text}'"


# ---- resampling -------------------------------------------------------------------------------------------------

_MEDIAN = _boot("deltas", "", "user_id", "median(delta)")


@query(f"WITH {_PAIRS}, {_MEDIAN}, ci AS (SELECT quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM reps) SELECT (SELECT count(*) FROM deltas) AS n, round((SELECT median(delta) FROM deltas), 6) AS mid, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM ci")
def bootstrap_median(spark, d):
    c = _cells(spark, d)
    a, b = (c.filter(F.col(ARMS) == x).select("user_id", "value") for x in ("purchase", "view"))
    deltas = resampling.paired(a, b, "user_id")
    reps = resampling.resampled_medians(deltas, [], "user_id", "delta", N_BOOT)
    point = ranking.quantiles(deltas, [], F.col("delta"), {"mid": 0.5}).crossJoin(deltas.agg(F.count("*").alias("n")))  # one row each
    return _rounded(point.crossJoin(resampling.interval(reps, [])))


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """(part, unit, bin, early, late): the mean values of either half of the month, of users with all of them."""
    e = read_table(spark, d, "events").withColumn("late", F.dayofmonth("ts") > 15)
    by = lambda late: F.avg(F.when(F.col("late") == late, F.col("value")))
    c = e.groupBy("user_id", ARMS).agg(by(False).alias("early"), by(True).alias("late")).filter("early is not null and late is not null")
    whole = c.groupBy("user_id").agg(F.count("*").alias("k")).filter("k = 5").select("user_id")
    return c.join(whole, "user_id").select(F.pmod("user_id", F.lit(2)).alias("part"), F.col("user_id").alias("unit"), F.col(ARMS).alias("bin"), "early", "late")


_HALVES = (
    "c AS (SELECT user_id, event_type, avg(value) FILTER (day(ts) <= 15) AS early, avg(value) FILTER (day(ts) > 15) AS late FROM events GROUP BY ALL HAVING early IS NOT NULL AND late IS NOT NULL), "
    "cells AS (SELECT user_id % 2 AS part, user_id AS unit, event_type AS bin, early, late FROM c WHERE user_id IN (SELECT user_id FROM c GROUP BY user_id HAVING count(*) = 5)), "
    "ref AS (SELECT event_type AS bin, var_pop(value) AS power FROM events GROUP BY ALL)"
)
_GATE = (
    f"{_HALVES}, units AS (SELECT part, unit, row_number() OVER (PARTITION BY part ORDER BY unit) - 1 AS i, count(*) OVER (PARTITION BY part) AS n FROM (SELECT DISTINCT part, unit FROM cells)), "
    f"dr AS (SELECT part, n, rep, CASE WHEN rep = 0 THEN k ELSE {_draw(_q('gate'), 'part', 'rep', 'k')} % n END AS i FROM (SELECT part, n, rep, unnest(range(n)) AS k FROM (SELECT part, n, unnest(range({N_GATE} + 1)) AS rep FROM (SELECT DISTINCT part, n FROM units)))), "
    "w AS (SELECT part, n, rep, i, count(*) AS w FROM dr GROUP BY ALL), "
    "pb AS (SELECT part, rep, bin, max(w.n) AS n, sum(w * early * early) / max(w.n) - (sum(w * early) / max(w.n)) ** 2 AS early, sum(w * late * late) / max(w.n) - (sum(w * late) / max(w.n)) ** 2 AS late FROM w JOIN units USING (part, i) JOIN cells USING (part, unit) GROUP BY ALL), "
    "tl AS (SELECT part, rep, max(n) AS n, sqrt(avg((log10(early) - log10(power)) ** 2)) AS early, sqrt(avg((log10(late) - log10(power)) ** 2)) AS late FROM pb JOIN ref USING (bin) WHERE early > 1e-12 AND late > 1e-12 AND power > 1e-12 GROUP BY part, rep), "
    "ci AS (SELECT part, quantile_cont(early - late, 0.025) AS lo, quantile_cont(early - late, 0.975) AS hi FROM tl WHERE rep > 0 GROUP BY part), "
    "gate AS (SELECT part, n, early, late, early - late AS difference, lo, hi, lo > 0 AS extend FROM tl JOIN ci USING (part) WHERE rep = 0)"
)


def _gates(spark: SparkSession, d: str) -> DataFrame:
    power = read_table(spark, d, "events").groupBy(F.col(ARMS).alias("bin")).agg(F.var_pop("value").alias("power"))
    return resampling.gate(_halves(spark, d), ["part"], power, N_GATE)


@query(f"WITH {_GATE} SELECT part, n, round(early, 6) AS early, round(late, 6) AS late, round(difference, 6) AS difference, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(difference / early, 6) AS relative, extend FROM gate")
def paired_gate(spark, d):
    return _rounded(_gates(spark, d))


@query(f"WITH {_GATE}, ds AS (SELECT unnest(range(3)) AS part) SELECT part, CASE WHEN n IS NULL THEN 'missing' WHEN extend THEN 'extend' ELSE 'stop' END AS decision, coalesce(n, 0) AS n FROM ds LEFT JOIN gate USING (part)")
def gate_table(spark, d):
    design = spark.range(3).select(F.col("id").alias("part"))
    told = design.join(_gates(spark, d), "part", "left")
    return told.select("part", F.when(F.col("n").isNull(), "missing").when(F.col("extend"), "extend").otherwise("stop").alias("decision"), F.coalesce("n", F.lit(0)).alias("n"))


def _perm(sample: str, group: str) -> str:
    """CTEs t, p: permutation p-values of the sides of ``sample`` (group, id, side, value)."""
    return (
        f"t AS (SELECT {group}, count(*) FILTER (side = 'a') AS na, avg(value) FILTER (side = 'a') - avg(value) FILTER (side = 'b') AS obs FROM {sample} GROUP BY {group}), "
        f"dp AS (SELECT {group}, rep, value, row_number() OVER (PARTITION BY {group}, rep ORDER BY {_draw(_q('perm'), group, 'rep', 'id', 'side')}, id, side) AS r FROM {sample}, (SELECT unnest(range(1, {N_PERM} + 1)) AS rep)), "
        f"st AS (SELECT {group}, rep, obs, avg(value) FILTER (r <= na) - avg(value) FILTER (r > na) AS stat FROM dp JOIN t USING ({group}) GROUP BY {group}, rep, obs), "
        f"p AS (SELECT {group}, obs, count(*) AS n_assignments, (1 + count(*) FILTER (abs(stat) >= abs(obs) - 1e-9 * greatest(1, abs(obs)))) / (1 + count(*)) AS p_value, 1 / (1 + count(*)) AS p_min FROM st GROUP BY {group}, obs)"
    )


@query(f"WITH {_DAILY}, sm AS (SELECT a.event_type, step AS id, x.side, CASE WHEN x.side = 'a' THEN a.v ELSE b.v END AS value FROM daily a JOIN daily b USING (step), (SELECT unnest(['a', 'b']) AS side) x WHERE a.event_type <> 'view' AND b.event_type = 'view'), {_perm('sm', 'event_type')} SELECT event_type, round(obs, 6) AS observed, n_assignments, round(p_value, 6) AS p_value, round(p_min, 6) AS p_min FROM p")
def contrast_permutation(spark, d):
    """The permutation part of the contrasts: each arm's days against those of the baseline arm."""
    daily = _daily(spark, d)
    base = daily.filter(F.col(ARMS) == "view").select("step", F.col("v").alias("b"))
    both = daily.filter(F.col(ARMS) != "view").join(base, "step")
    sides = F.array(F.struct(F.lit("a").alias("side"), F.col("v").alias("value")), F.struct(F.lit("b").alias("side"), F.col("b").alias("value")))
    return _rounded(resampling.sampled_permutation(both.select(ARMS, F.col("step").alias("id"), F.inline(sides)), N_PERM, [ARMS]))


@query(f"WITH {_PAIRS}, sm AS (SELECT 1 AS one, user_id AS id, CASE WHEN {_draw(_q('half'), 'user_id')} % 2 = 0 THEN 'a' ELSE 'b' END AS side, delta AS value FROM deltas), {_perm('sm', 'one')} SELECT one, round(obs, 6) AS observed, n_assignments, round(p_value, 6) AS p_value, round(p_min, 6) AS p_min FROM p")
def interaction_permutation(spark, d):
    """The interaction's p-value: the labels of the halves are dealt anew over the paired differences."""
    c = _cells(spark, d)
    a, b = (c.filter(F.col(ARMS) == x).select("user_id", "value") for x in ("purchase", "view"))
    half = F.when(F.pmod(draw("half", F.col("user_id")), F.lit(2)) == 0, "a").otherwise("b")
    sample = resampling.paired(a, b, "user_id").select(F.lit(1).alias("one"), F.col("user_id").alias("id"), half.alias("side"), F.col("delta").alias("value"))
    return _rounded(resampling.sampled_permutation(sample, N_PERM, ["one"]))


@query(f"WITH k AS (SELECT rep, c_custkey, row_number() OVER (PARTITION BY rep ORDER BY {_draw(_q('subset'), 'rep', 'c_custkey')}, c_custkey) AS r FROM customer, (SELECT unnest(range(1, 6)) AS rep)) SELECT rep, count(*) AS n, sum(c_custkey)::bigint AS key_sum FROM k WHERE r <= 20 GROUP BY rep")
def subset_draws(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rep"))
    ranked = ranking.numbered(c.withColumn("h", draw("subset", F.col("rep"), F.col("c_custkey"))), ["rep"], ["h", "c_custkey"])
    return ranked.filter("i < 20").groupBy("rep").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


@query(f"WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), l AS (SELECT k, {_draw(_q('frozen'), 'k')} AS h FROM (SELECT unnest(range(50)) AS k)), s AS (SELECT k, c_custkey FROM l JOIN n ON n.i = l.h % n.n) SELECT count(*) AS n, count(DISTINCT c_custkey) AS distinct_n, sha256(string_agg(c_custkey::varchar, ',' ORDER BY k)) AS digest FROM s")
def frozen_seed_list(spark, d):
    """A list of 50 draws with replacement, pinned by its digest."""
    c = ranking.numbered(read_table(spark, d, "customer").select("c_custkey"), [], ["c_custkey"])
    drawn = spark.range(50).select(F.col("id").alias("k")).withColumn("h", draw("frozen", F.col("k"))).crossJoin(c.agg(F.max("n").alias("n")))  # one row
    s = drawn.select("k", F.pmod("h", "n").alias("i")).join(c.select("c_custkey", F.col("i").cast("bigint").alias("i")), "i")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",")  # 50 entries
    return s.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_n"), F.sha2(listed, 256).alias("digest"))


# ---- thresholds and tables ------------------------------------------------------------------------------------------

_SETTLE = f"{_DAILY}, b AS (SELECT arg_max(v, step) AS thr FROM daily WHERE event_type = 'view'), x AS (SELECT daily.*, thr * f AS thr, f FROM daily, b, (SELECT unnest([1.0, 1.1]::double[]) AS f)), a AS (SELECT event_type, f, max(step) FILTER (v > thr) AS la FROM x GROUP BY ALL), st AS (SELECT event_type, f, min(step) FILTER (v <= thr) AS first_step, min(step) FILTER (la IS NULL OR step > la) AS settle_step FROM x JOIN a USING (event_type, f) GROUP BY ALL)"


def _settled(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, f, first_step, settle_step) for two thresholds: the last day's view mean, and a tenth more."""
    daily = _daily(spark, d)
    thr = F.broadcast(_last_view(daily))  # one row
    x = daily.crossJoin(thr).withColumn("f", F.explode(F.array(F.lit(1.0), F.lit(1.1)))).withColumn("thr", F.col("thr") * F.col("f"))
    x = x.withColumn("cell", F.struct(ARMS, "f"))
    first = curves.first_crossing(x, "cell", F.col("thr"))
    return first.join(curves.settling_step(x, "cell", F.col("thr")), "cell").select("cell.*", "first_step", "settle_step")


@query(f"WITH {_SETTLE} SELECT event_type, f, first_step, settle_step, CASE WHEN first_step IS NULL THEN 'not reached' WHEN settle_step IS NULL THEN 'not settled' ELSE 'ok' END AS status FROM st")
def crossing_table(spark, d):
    status = F.when(F.col("first_step").isNull(), "not reached").when(F.col("settle_step").isNull(), "not settled").otherwise("ok")
    return _settled(spark, d).withColumn("status", status)


@query(f"WITH {_SETTLE}, dl AS (SELECT s.event_type, s.f, s.settle_step - o.settle_step AS later FROM st s JOIN st o ON s.f = o.f AND o.event_type = 'view' WHERE s.event_type <> 'view'), pv AS (SELECT event_type, max(later) FILTER (f = 1.0) AS tight, max(later) FILTER (f = 1.1) AS loose FROM dl GROUP BY event_type) SELECT event_type, tight, loose, tight - loose AS difference FROM pv")
def settle_deltas(spark, d):
    s = _settled(spark, d)
    base = s.filter(F.col(ARMS) == "view").select("f", F.col("settle_step").alias("base"))
    later = s.filter(F.col(ARMS) != "view").join(base, "f").withColumn("later", F.col("settle_step") - F.col("base"))
    by = lambda f: F.max(F.when(F.col("f") == f, F.col("later")))
    return later.groupBy(ARMS).agg(by(1.0).alias("tight"), by(1.1).alias("loose")).withColumn("difference", F.col("tight") - F.col("loose"))


@query(f"WITH {_DAILY} SELECT event_type, count(*) AS n, round(avg(v), 6) AS late_mean FROM daily WHERE step IN (26, 27, 28, 29, 30) GROUP BY event_type")
def late_window(spark, d):
    return _rounded(_daily(spark, d).filter(F.col("step").isin(26, 27, 28, 29, 30)).groupBy(ARMS).agg(F.count("*").alias("n"), F.avg("v").alias("late_mean")))


@query("SELECT l_returnflag, round(avg(CASE WHEN l_quantity >= 5 THEN l_quantity END), 6) AS quantity, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS discount, count(*) FILTER (l_quantity < 5) AS n_nan FROM lineitem GROUP BY ALL")
def nan_means(spark, d):
    li = read_table(spark, d, "lineitem")
    held = li.select("l_returnflag", *(F.when(ok, F.col(c)).otherwise(F.lit(float("nan"))).alias(n) for n, c, ok in (("quantity", "l_quantity", F.col("l_quantity") >= 5), ("discount", "l_discount", F.col("l_discount") > 0))))
    mean = lambda c: F.avg(F.nanvl(F.col(c), F.lit(None).cast("double")))
    return _rounded(held.groupBy("l_returnflag").agg(mean("quantity").alias("quantity"), mean("discount").alias("discount"), F.count_if(F.isnan("quantity")).alias("n_nan")))


@query("WITH t AS (SELECT r_name, n_name, CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS tier FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT tier, r_name, n_name, row_number() OVER (ORDER BY tier, r_name, n_name) - 1 AS cell FROM t")
def design_ordinals(spark, d):
    t = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tier = F.when(F.col("r_name") == "EUROPE", 0).when(F.col("r_name") == "ASIA", 1).otherwise(2)
    return ranking.numbered(t.select(tier.alias("tier"), "r_name", "n_name"), [], ["tier", "r_name", "n_name"]).select("tier", "r_name", "n_name", F.col("i").alias("cell"))


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(spark, d):
    return _rounded(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10))


@query("WITH f AS (SELECT c_mktsegment, c_custkey, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS r FROM customer) SELECT c_mktsegment, c_name, min(o_orderkey) AS chosen FROM f LEFT JOIN orders ON o_custkey = c_custkey WHERE r <= 3 GROUP BY ALL")
def first_entities(spark, d):
    """The first three customers of each segment by name, with one designated order each."""
    c = ranking.numbered(read_table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], ["c_name", "c_custkey"]).filter("i < 3")
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return c.join(o, "c_custkey", "left").groupBy("c_mktsegment", "c_name").agg(F.min("o_orderkey").alias("chosen"))


@query("WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer), w AS (SELECT DISTINCT floor(k * (n - 1) / 6.0)::bigint AS i FROM (SELECT unnest(range(7)) AS k), (SELECT max(n) AS n FROM n)) SELECT i::bigint AS i, c_custkey FROM n JOIN w USING (i)")
def even_picks(spark, d):
    c = ranking.numbered(read_table(spark, d, "customer").select("c_custkey"), [], ["c_custkey"])
    picks = c.agg(F.max("n").alias("n")).select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.floor(k * (F.col("n") - 1) / 6.0)))).alias("i"))
    return c.select(F.col("i").cast("bigint").alias("i"), "c_custkey").join(F.broadcast(picks), "i")  # seven rows


@query("SELECT event_type || ':' || (value > 50)::varchar AS note, min(event_id) AS first_id, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY note")
def ordered_notes(spark, d):
    note = F.concat_ws(":", ARMS, (F.col("value") > 50).cast("string"))
    first = read_table(spark, d, "events").groupBy(note.alias("note")).agg(F.min("event_id").alias("first_id"))
    return ranking.numbered(first, [], ["first_id"]).select("note", "first_id", (F.col("i") + 1).alias("place"))


@query("SELECT 'customer' AS shard, count(*) AS n, round(sum(c_acctbal), 6) AS total FROM customer UNION ALL SELECT 'supplier', count(*), round(sum(s_acctbal), 6) FROM supplier")
def concat_parts(spark, d):
    """Shards of one schema, one after another."""
    part = lambda t, p: read_table(spark, d, t).select(F.lit(t).alias("shard"), F.col(f"{p}_acctbal").alias("v"))
    return part("customer", "c").unionByName(part("supplier", "s")).groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "orders", "events", "documents")))
def row_counts(spark, d):
    one = [read_table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("region", "orders", "events", "documents")]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


# ---- joins with a reason, and picks by position ---------------------------------------------------------------------------

@query("WITH s AS (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 0 GROUP BY ALL), l AS (SELECT c_custkey, CASE WHEN c_nationkey % 7 = 3 THEN -1 ELSE c_nationkey END AS nk FROM customer) SELECT CASE WHEN n_nationkey IS NULL THEN 'unknown nation' WHEN k IS NULL THEN 'no supplier' WHEN k < 3 THEN 'few suppliers' ELSE 'ok' END AS reason, count(*) AS n, min(c_custkey) AS first_key FROM l LEFT JOIN nation ON nk = n_nationkey LEFT JOIN s ON nk = s_nationkey GROUP BY reason")
def lookup_reason(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 7 == 3, -1).otherwise(F.col("c_nationkey")).alias("nk"))
    k = read_table(spark, d, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    j = c.join(read_table(spark, d, "nation"), F.col("nk") == F.col("n_nationkey"), "left").join(k, F.col("nk") == F.col("s_nationkey"), "left")
    reason = F.when(F.col("n_nationkey").isNull(), "unknown nation").when(F.col("k").isNull(), "no supplier").when(F.col("k") < 3, "few suppliers").otherwise("ok")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


@query("WITH t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY ALL) SELECT count(*) AS n, count(*) FILTER (pos IS NULL) AS n_lost, sum(pos)::bigint AS pos_sum FROM b LEFT JOIN t ON o_custkey = c_custkey")
def ordered_positions(spark, d):
    """Keys to their places in a sorted part of the table."""
    t = ranking.numbered(read_table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey"), [], ["c_custkey"])
    b = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return b.join(t, "c_custkey", "left").agg(F.count("*").alias("n"), F.count_if(F.col("i").isNull()).alias("n_lost"), F.sum("i").cast("bigint").alias("pos_sum"))


@query("WITH w AS (SELECT o_orderkey AS k, o_orderdate FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT l_orderkey AS k, l_linenumber AS row, l_shipdate, l_partkey FROM lineitem), m AS (SELECT k, row, l_shipdate, lag(l_shipdate) OVER (PARTITION BY k ORDER BY row, l_shipdate, l_partkey) AS before FROM s JOIN w USING (k)) SELECT count(*) AS n, count(*) FILTER (l_shipdate < before) AS n_out_of_order FROM m")
def ordered_selection(spark, d):
    """The rows of a stream that a list names; steps back within a shard are counted."""
    from pyspark.sql import Window

    w = read_table(spark, d, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    m = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey").join(w, "l_orderkey")
    before = F.lag("l_shipdate").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey"))
    return m.withColumn("before", before).agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate") < F.col("before")).alias("n_out_of_order"))


@query("WITH o AS (SELECT o_custkey, min(o_orderkey) FILTER (o_totalprice > 200000 AND o_orderkey >= 100) AS chosen FROM orders GROUP BY ALL) SELECT o.o_custkey, chosen, count(*) FILTER (o_orderkey >= 100 AND (chosen IS NULL OR o_orderkey < chosen)) AS skipped FROM o JOIN orders USING (o_custkey) GROUP BY ALL")
def first_usable(spark, d):
    """The first order from an offset on that is usable, and how many were skipped for it."""
    o = read_table(spark, d, "orders").filter("o_orderkey >= 100")
    every = read_table(spark, d, "orders").select("o_custkey").distinct()
    chosen = o.groupBy("o_custkey").agg(F.min(F.when(F.col("o_totalprice") > 200000, F.col("o_orderkey"))).alias("chosen"))
    skipped = o.join(chosen, "o_custkey").groupBy("o_custkey", "chosen").agg(F.count_if(F.col("chosen").isNull() | (F.col("o_orderkey") < F.col("chosen"))).alias("skipped"))
    return every.join(skipped, "o_custkey", "left").select("o_custkey", "chosen", F.coalesce("skipped", F.lit(0)).alias("skipped"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, count(*) AS n_writes FROM events GROUP BY ALL")
def last_wins(spark, d):
    return _rounded(read_table(spark, d, "events").groupBy("user_id").agg(F.max_by(ARMS, "event_id").alias(ARMS), F.max_by("value", "event_id").alias("value"), F.count("*").alias("n_writes")))


@query("SELECT (doc_id % 8)::bigint AS shard, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def rank_shards(spark, d):
    return read_table(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(8)).cast("bigint").alias("shard")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


# ---- contracts and verdicts ---------------------------------------------------------------------------------------------

_RULES = {
    "high_discount": "l_discount > 0.09",
    "no_quantity": "l_quantity <= 0",
    "line_number": "l_linenumber NOT BETWEEN 1 AND 6",
    "tax_over_discount": "l_tax > l_discount + 0.07",
}
_RULE_SQL = " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({sql}) AS n, min(l_orderkey) FILTER ({sql}) AS first_key FROM lineitem" for name, sql in _RULES.items())
_FOUND = (
    f"{_RULE_SQL} UNION ALL SELECT 'repeated_part', count(*), min(key) FROM (SELECT min(l_orderkey) AS key FROM lineitem GROUP BY l_partkey, l_suppkey, l_shipdate HAVING count(*) > 1) "
    "UNION ALL SELECT 'orphan', count(*), min(l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"
)


def _found(spark: SparkSession, d: str) -> list[DataFrame]:
    li = read_table(spark, d, "lineitem")
    parents = read_table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return [
        contracts.violations(li, "l_orderkey", {name: F.expr(sql) for name, sql in _RULES.items()}),
        contracts.duplicates(li, ["l_partkey", "l_suppkey", "l_shipdate"], "repeated_part", "l_orderkey"),
        contracts.orphans(li, parents, "l_orderkey", "orphan"),
    ]


@query(_FOUND)
def contract_violations(spark, d):
    a, b, c = _found(spark, d)
    return a.unionByName(b).unionByName(c)


@query(f"WITH f AS ({_FOUND}) SELECT count(*) AS checks, count(*) FILTER (n > 0) AS broken, CASE WHEN count(*) FILTER (n > 0 AND rule IN ('no_quantity', 'orphan')) > 0 THEN 'FAIL' WHEN count(*) FILTER (n > 0) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS verdict FROM f")
def collection_verdict(spark, d):
    return contracts.verdict(_found(spark, d), ["no_quantity", "orphan"])


@query("WITH l AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN substr(props, 1, 5) WHEN event_id % 89 = 0 THEN '{\"k\": NaN}' ELSE props END AS line FROM events) SELECT event_id, line, 'unreadable' AS problem FROM l WHERE event_id % 97 = 0 OR event_id % 89 = 0")
def jsonl_problems(spark, d):
    """Lines that can't be read are listed, not fatal: some are torn, some hold NaN."""
    line = F.when(F.col("event_id") % 97 == 0, F.substring("props", 1, 5)).when(F.col("event_id") % 89 == 0, '{"k": NaN}').otherwise(F.col("props"))
    read = contracts.parsed(read_table(spark, d, "events").select("event_id", line.alias("line")), "line", "k double")
    return read.filter("problem is not null").select("event_id", "line", "problem")


@query("SELECT event_id, event_type, event_type NOT IN ('purchase', 'view') AND value > 90 AS bad_value, event_id % 5 = 0 AS bad_keys FROM events WHERE (event_type NOT IN ('purchase', 'view') AND value > 90) OR event_id % 5 = 0")
def kind_rules(spark, d):
    """Rules by kind: every fifth record has a key too many, and some kinds bound the value."""
    e = read_table(spark, d, "events").withColumn("doc", F.when(F.col("event_id") % 5 == 0, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "extra": 1}'))).otherwise(F.col("props")))
    keys = F.json_object_keys("doc")
    bad_keys = F.size(F.array_except(keys, F.array(F.lit("k")))) > 0
    bad_value = ~F.col(ARMS).isin("purchase", "view") & (F.col("value") > 90)
    return e.select("event_id", ARMS, bad_value.alias("bad_value"), bad_keys.alias("bad_keys")).filter("bad_value or bad_keys")


@query("SELECT c_custkey, unnest(['id.name', 'id.segment', 'money.balance', 'nation']) AS path, unnest([c_name, c_mktsegment, c_acctbal::int::varchar, c_nationkey::varchar]) AS value FROM customer")
def flatten_leaves(spark, d):
    c = read_table(spark, d, "customer")
    nested = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("id"), F.struct(F.rint("c_acctbal").cast("int").alias("balance")).alias("money"), F.col("c_nationkey").alias("nation"))
    return contracts.leaves(nested, "c_custkey")


@query("WITH r AS (SELECT n_nationkey, sha256('{\"region\":' || n_regionkey || ',\"size\":' || length(n_name) || '}') AS recipe FROM nation), k AS (SELECT recipe, count(*) AS n, min(n_nationkey) AS first_key FROM r GROUP BY ALL) SELECT recipe, n, first_key, row_number() OVER (ORDER BY n DESC, first_key) = 1 AS modal FROM k")
def recipe_hash(spark, d):
    """Recipes without the excluded columns, as sorted JSON, hashed; the most frequent one is the norm."""
    n = read_table(spark, d, "nation").withColumn("size", F.length("n_name")).withColumnRenamed("n_regionkey", "region")
    text = F.to_json(F.struct(*sorted(c for c in n.columns if c not in ("n_nationkey", "n_name"))))
    k = n.groupBy(F.sha2(text, 256).alias("recipe")).agg(F.count("*").alias("n"), F.min("n_nationkey").alias("first_key"))
    return ranking.numbered(k.withColumn("less", -F.col("n")).withColumnRenamed("n", "size"), [], ["less", "first_key"]).select("recipe", F.col("size").alias("n"), "first_key", (F.col("i") == 0).alias("modal"))


@query(f"WITH a AS (SELECT c_custkey FROM customer WHERE {_draw(_q('one'), 'c_custkey')} % 5 < 4), b AS (SELECT c_custkey FROM customer WHERE {_draw(_q('two'), 'c_custkey')} % 5 < 4) SELECT count(*) FILTER (b.c_custkey IS NULL) AS only_one, count(*) FILTER (a.c_custkey IS NULL) AS only_two, count(*) FILTER (a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL) AS \"both\" FROM a FULL JOIN b ON a.c_custkey = b.c_custkey")
def entity_lists_equal(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey")
    one, two = (c.filter(F.pmod(draw(s, F.col("c_custkey")), F.lit(5)) < 4) for s in ("one", "two"))
    return contracts.differing_lists(one, two, "c_custkey")


@query("WITH v AS (SELECT vec_id AS id, embedding::double[] AS vec FROM embeddings UNION ALL SELECT -1, list_resize([]::double[], 64, 0.5)) SELECT id, list_max(vec) = list_min(vec) AS constant, abs(list_avg(vec)) > 0.02 AS off_range FROM v WHERE list_max(vec) = list_min(vec) OR abs(list_avg(vec)) > 0.02")
def constant_rows(spark, d):
    """Rows without variation or with a mean out of range; one constant row is put in."""
    v = _vectors(spark, d).select("id", "vec").unionByName(spark.range(1).select((F.col("id") - 1).alias("id"), F.array_repeat(F.lit(0.5), 64).alias("vec")))
    mean = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) / F.size("vec")
    told = v.select("id", (F.array_max("vec") == F.array_min("vec")).alias("constant"), (F.abs(mean) > 0.02).alias("off_range"))
    return told.filter("constant or off_range")


@query("SELECT 'some' AS name, count(*) FILTER (value < 10) AS n_nan, count(*) FILTER (value < 10) IN (0, count(*)) AS whole FROM events UNION ALL SELECT 'all', count(*), true FROM events UNION ALL SELECT 'none', 0, true")
def nan_columns(spark, d):
    e = read_table(spark, d, "events")
    nan = F.lit(float("nan"))
    return contracts.nan_columns(e.select(F.when(F.col("value") < 10, nan).otherwise(F.col("value")).alias("some"), nan.alias("all"), F.abs("value").alias("none")), ["some", "all", "none"])


@query("WITH p AS (SELECT s_suppkey, name, value FROM (SELECT s_suppkey, s_nationkey::varchar AS nation, (s_acctbal > 0)::varchar AS positive FROM supplier) UNPIVOT (value FOR name IN (nation, positive))), x(name, want) AS (VALUES ('nation', '7'), ('positive', 'true')) SELECT name, count(*) AS n, count(*) FILTER (value <> want) AS n_off FROM p JOIN x USING (name) GROUP BY name")
def protocol_check(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"), (F.col("s_acctbal") > 0).cast("string").alias("positive"))
    want = spark.createDataFrame([("nation", "7"), ("positive", "true")], "name string, want string")
    p = s.unpivot(["s_suppkey"], ["nation", "positive"], "name", "value").join(F.broadcast(want), "name")  # two rows
    return p.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("value") != F.col("want")).alias("n_off"))


@query("WITH f AS (SELECT l_orderkey, min({'n': l_linenumber, 'f': l_returnflag}).f AS first FROM lineitem GROUP BY ALL) SELECT first, count(*) AS n, count(*) FILTER (l_returnflag <> first) AS n_differ FROM lineitem JOIN f USING (l_orderkey) GROUP BY first")
def common_draws(spark, d):
    """Whether the rows of a group all have what its first one has."""
    li = read_table(spark, d, "lineitem")
    first = li.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_returnflag"))["l_returnflag"].alias("first"))
    return li.join(first, "l_orderkey").groupBy("first").agg(F.count("*").alias("n"), F.count_if(~F.col("l_returnflag").eqNullSafe(F.col("first"))).alias("n_differ"))


@query("SELECT o_orderpriority, round(max(o_totalprice) / min(o_totalprice), 6) AS spread, CASE WHEN min(o_totalprice) > 1000 AND max(o_totalprice) < 499000 THEN 'as known' WHEN max(o_totalprice) >= 499000 THEN 'too high' ELSE 'too low' END AS outcome FROM orders GROUP BY ALL")
def known_results(spark, d):
    lo, hi = F.min("o_totalprice"), F.max("o_totalprice")
    outcome = F.when((lo > 1000) & (hi < 499000), "as known").when(hi >= 499000, "too high").otherwise("too low")
    return _rounded(read_table(spark, d, "orders").groupBy("o_orderpriority").agg((hi / lo).alias("spread"), outcome.alias("outcome")))


@query("WITH t AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS unit FROM lineitem) SELECT count(*) AS n, count(*) FILTER (abs(unit * l_quantity - l_extendedprice) > 1e-9 * l_extendedprice) AS n_rate, count(*) FILTER (log2(l_quantity) = floor(log2(l_quantity))) AS n_power_of_two, count(*) FILTER (unit < 100) AS n_cheap FROM t")
def value_invariants(spark, d):
    t = read_table(spark, d, "lineitem").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    log = F.log2("l_quantity")
    return t.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("unit") * F.col("l_quantity") - F.col("l_extendedprice")) > 1e-9 * F.col("l_extendedprice")).alias("n_rate"), F.count_if(F.round(log, 12) == F.floor(F.round(log, 12))).alias("n_power_of_two"), F.count_if(F.col("unit") < 100).alias("n_cheap"))


# ---- outcomes -------------------------------------------------------------------------------------------------------------

@query(f"WITH {_PAIRS}, g AS (SELECT user_id % 7 AS part, avg(delta) AS d, count(*) AS n, avg((delta > 0)::int) AS up, bool_and(delta > 0) AS all_up, bool_and(delta < 0) AS all_down FROM deltas GROUP BY ALL) SELECT part, n, round(up, 6) AS up_share, CASE WHEN all_up THEN 'gain' WHEN all_down THEN 'loss' WHEN up >= 0.5 THEN 'mixed, mostly gain' ELSE 'mixed, mostly loss' END AS outcome FROM g")
def gain_classes(spark, d):
    c = _cells(spark, d)
    a, b = (c.filter(F.col(ARMS) == x).select("user_id", "value") for x in ("purchase", "view"))
    up, down = F.col("delta") > 0, F.col("delta") < 0
    share = F.avg(up.cast("int"))
    outcome = F.when(F.bool_and(up), "gain").when(F.bool_and(down), "loss").when(share >= 0.5, "mixed, mostly gain").otherwise("mixed, mostly loss")
    return _rounded(resampling.paired(a, b, "user_id").groupBy(F.pmod("user_id", F.lit(7)).alias("part")).agg(F.count("*").alias("n"), share.alias("up_share"), outcome.alias("outcome")))


@query(f"WITH {_CELLS}, dl AS (SELECT a.event_type, avg(a.value - b.value) AS d FROM cells a JOIN cells b USING (user_id) WHERE b.event_type = 'view' AND a.event_type <> 'view' GROUP BY ALL), r AS (SELECT d AS rd FROM dl WHERE event_type = 'purchase') SELECT event_type, round(d, 6) AS delta, CASE WHEN sign(d) <> sign(rd) THEN 'opposite' WHEN abs(d) >= 0.5 * abs(rd) THEN 'comparable' ELSE 'smaller' END AS reading FROM dl, r WHERE event_type <> 'purchase'")
def comparator_rule(spark, d):
    """Effects read against a comparator's: at least half as large, smaller, or the other way."""
    c = _cells(spark, d)
    base = c.filter(F.col(ARMS) == "view").select("user_id", F.col("value").alias("b"))
    told = c.filter(F.col(ARMS) != "view").join(base, "user_id").groupBy(ARMS).agg(F.avg(F.col("value") - F.col("b")).alias("delta"))
    rule = told.filter(F.col(ARMS) == "purchase").select(F.col("delta").alias("rd"))
    reading = F.when(F.signum("delta") != F.signum("rd"), "opposite").when(F.abs("delta") >= 0.5 * F.abs("rd"), "comparable").otherwise("smaller")
    return _rounded(told.filter(F.col(ARMS) != "purchase").crossJoin(F.broadcast(rule)).select(ARMS, "delta", reading.alias("reading")))  # one row


@query(f"WITH {_CELLS} SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS lo, round(max(value), 6) AS hi, CASE WHEN count(*) = (SELECT count(DISTINCT user_id) FROM events) THEN 'complete' ELSE 'incomplete: ' || count(*) || '/' || (SELECT count(DISTINCT user_id) FROM events) END AS status FROM cells GROUP BY event_type")
def cell_table(spark, d):
    users = read_table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"))
    t = _cells(spark, d).groupBy(ARMS).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(users)  # one row
    status = F.when(F.col("n") == F.col("users"), "complete").otherwise(F.concat_ws("", F.lit("incomplete: "), "n", F.lit("/"), "users"))
    return _rounded(t.withColumn("status", status).drop("users"))


@query(f"WITH {_CELLS}, w AS (SELECT user_id, max(value) FILTER (event_type = 'view') AS v, max(value) FILTER (event_type = 'click') AS c, max(value) FILTER (event_type = 'purchase') AS p FROM cells GROUP BY ALL) SELECT round(avg(p - v), 6) AS purchase_view, round(avg(p - c), 6) AS purchase_click, round(avg(c - v), 6) AS click_view, count(p - v) AS n_first, count(p - c) AS n_second, count(c - v) AS n_third FROM w")
def control_pairs(spark, d):
    """Three pairings of two arms and a control, each on the units that both have."""
    w = _cells(spark, d).groupBy("user_id").pivot(ARMS, ["view", "click", "purchase"]).agg(F.first("value"))
    p, c, v = F.col("purchase"), F.col("click"), F.col("view")
    return _rounded(w.agg(F.avg(p - v).alias("purchase_view"), F.avg(p - c).alias("purchase_click"), F.avg(c - v).alias("click_view"), F.count(p - v).alias("n_first"), F.count(p - c).alias("n_second"), F.count(c - v).alias("n_third")))


@query(f"WITH {_DAILY}, m AS (SELECT 'late' AS part, event_type, avg(v) AS v FROM daily WHERE step > 25 GROUP BY ALL UNION ALL SELECT 'early', event_type, avg(v) FROM daily WHERE step <= 5 GROUP BY ALL), p AS (SELECT event_type, max(v) FILTER (part = 'early') AS early, max(v) FILTER (part = 'late') AS late FROM m GROUP BY event_type) SELECT event_type, round(early, 6) AS early, round(late, 6) AS late, CASE WHEN late > early AND late > 50 THEN 'lifts and stays high' WHEN late > early THEN 'lifts' WHEN late > 50 THEN 'stays high' ELSE 'neither' END AS reading FROM p")
def sweep_reading(spark, d):
    """Parts of a sweep, merged, with a reading of two yes-or-no facts."""
    daily = _daily(spark, d)
    part = lambda name, rows: rows.groupBy(ARMS).agg(F.avg("v").alias("v")).withColumn("part", F.lit(name))
    m = part("late", daily.filter("step > 25")).unionByName(part("early", daily.filter("step <= 5")))
    p = m.groupBy(ARMS).pivot("part", ["early", "late"]).agg(F.first("v"))
    lifts, high = F.col("late") > F.col("early"), F.col("late") > 50
    reading = F.when(lifts & high, "lifts and stays high").when(lifts, "lifts").when(high, "stays high").otherwise("neither")
    return _rounded(p.withColumn("reading", reading))


# ---- vectors and spectra ----------------------------------------------------------------------------------------------------

@query(f"WITH {_VEC} SELECT id, round(list_avg(list_transform(vec, lambda x: (x > 0.05)::int)), 6) AS share FROM vec")
def foreground_share(spark, d):
    above = F.aggregate(F.transform("vec", lambda x: (x > 0.05).cast("int")), F.lit(0), lambda a, x: a + x) / F.size("vec")
    return _rounded(_vectors(spark, d).select("id", above.alias("share")))


@query(f"WITH {_LONG}, p AS (SELECT id, pos // 4 AS cell, avg(x) AS m FROM long GROUP BY ALL), c AS (SELECT id, cell, m - avg(m) OVER (PARTITION BY id) AS m FROM p) SELECT id, cell::int AS cell, round(m / sqrt(sum(m * m) OVER (PARTITION BY id)), 6) AS x FROM c")
def thumbnails(spark, d):
    """Vectors pooled by fours, centred and scaled to length one."""
    # Pooled from the table's own column, as a derived array is made anew for each cell; dealt by id, as a file may be one row group.
    rows = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e")).repartition("id")
    pooled = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.slice("e", k * 4 + 1, 4), F.lit(0.0), lambda a, x: a + x.cast("double")) / 4)
    unit = rows.select("id", pooled.alias("p")).select("id", vectors.unit(F.col("p")).alias("u"))
    return _rounded(unit.select("id", F.posexplode("u").alias("cell", "x")))


def _log_edges(spark: SparkSession, n: int, low: float, high: float) -> DataFrame:
    """(bin, lo, hi, is_last): n bins of equal width in the logarithm."""
    edge = lambda k: F.exp(F.log(F.lit(low)) + (F.log(F.lit(high)) - F.log(F.lit(low))) * k / n)
    return spark.range(n).select(F.col("id").cast("int").alias("bin"), edge(F.col("id")).alias("lo"), edge(F.col("id") + 1).alias("hi"), (F.col("id") == n - 1).alias("is_last"))


def _log_bins(n: int, low: float, high: float) -> str:
    edge = lambda k: f"exp(ln({low}) + (ln({high}) - ln({low})) * {k} / {n})"
    return f"bins AS (SELECT k::int AS bin, {edge('k')} AS lo, {edge('(k + 1)')} AS hi, k = {n - 1} AS is_last FROM (SELECT unnest(range({n})) AS k))"


_POWER = "power AS (SELECT i, j, CASE WHEN i = 0 AND j = 0 THEN 0.0 ELSE var_pop(c) END AS power FROM (SELECT id, i, j, sum(x * b) AS c FROM long JOIN basis USING (pos) GROUP BY ALL) GROUP BY i, j)"
_AT = "sqrt(i * i + j * j) / 2 >= lo AND (sqrt(i * i + j * j) / 2 < hi OR (is_last AND sqrt(i * i + j * j) / 2 = hi))"


@query(f"WITH {_LONG}, {_BASIS}, {_POWER}, {_log_bins(48, 0.49, 4.01)}, m AS (SELECT bin, count(*) AS k, avg(power) AS p FROM bins JOIN power ON {_AT} WHERE i + j > 0 GROUP BY bin) SELECT bin, coalesce(k, 0) AS n_modes, round(CASE WHEN p > 1e-12 THEN log10(p) END, 6) AS log_power FROM bins LEFT JOIN m USING (bin)")
def log_profile(spark, d):
    """48 logarithmic bins; a bin without modes has a null power."""
    bins = _log_edges(spark, 48, 0.49, 4.01)
    m = spectra.binned(_power(spark, d).filter("i + j > 0"), bins, spectra.radius()).groupBy("bin").agg(F.count("*").alias("k"), F.avg("power").alias("p"))
    out = bins.select("bin").join(m, "bin", "left")
    return _rounded(out.select("bin", F.coalesce("k", F.lit(0)).alias("n_modes"), F.when(F.col("p") > 1e-12, F.log10("p")).alias("log_power")))


_PER_GROUP = "pg AS (SELECT grp, i, j, var_pop(c) AS power FROM (SELECT id, grp, i, j, sum(x * b) AS c FROM long JOIN basis USING (pos) WHERE i + j > 0 GROUP BY ALL) GROUP BY ALL)"
_OCTAVES = "bins AS (SELECT k::int AS bin, 0.5 * 2.0 ** k AS lo, 0.5 * 2.0 ** (k + 1) AS hi, k = 3 AS is_last FROM (SELECT unnest(range(4)) AS k))"


@query(f"WITH {_LONG}, {_BASIS}, {_PER_GROUP}, {_OCTAVES}, s AS (SELECT grp, bin, sum(power) AS p, avg(power) AS m FROM pg JOIN bins ON {_AT} GROUP BY ALL), w AS (SELECT bin, avg(m) AS m FROM s GROUP BY bin), e AS (SELECT grp, log10(s.m) - log10(w.m) AS d FROM s JOIN w USING (bin)) SELECT grp, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rms, round(avg(d), 6) AS level, round(stddev_pop(d), 6) AS shape FROM e GROUP BY grp")
def octave_summary(spark, d):
    """For each group: the octaves' log differences from the mean profile, as rms, level and shape."""
    bins = spectra.octave_bins(spark, 4)
    s = spectra.radial_profile(_power(spark, d, ["grp"]), bins, ["grp"])
    w = s.groupBy("bin").agg(F.avg("mean_power").alias("m"))
    e = s.join(w, "bin").select("grp", (F.log10("mean_power") - F.log10("m")).alias("d"))
    return _rounded(e.groupBy("grp").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"), F.avg("d").alias("level"), F.stddev_pop("d").alias("shape")))


@query(f"WITH {_LONG}, {_BASIS}, {_PER_GROUP}, {_OCTAVES}, s AS (SELECT grp, bin, sum(power) AS p FROM pg JOIN bins ON {_AT} GROUP BY ALL) SELECT grp, bin, round(p / sum(p) OVER (PARTITION BY grp), 6) AS share FROM s")
def stratum_profile(spark, d):
    from pyspark.sql import Window

    s = spectra.binned(_power(spark, d, ["grp"]).filter("i + j > 0"), spectra.octave_bins(spark, 4), spectra.radius()).groupBy("grp", "bin").agg(F.sum("power").alias("p"))
    return _rounded(s.select("grp", "bin", (F.col("p") / F.sum("p").over(Window.partitionBy("grp"))).alias("share")))


@query(f"WITH {_LONG}, {_BASIS}, c AS (SELECT id, i, j, sum(x * b) AS c FROM long JOIN basis USING (pos) WHERE i + j > 0 GROUP BY ALL), m AS (SELECT i, j, var_pop(c) AS p, avg(c) AS mu, exp(-(pi() ** 2) * (i * i + j * j) / 128) AS d FROM c GROUP BY i, j) SELECT round(sum(p * d * d) / sum(p), 6) AS inherited, round(sum((1 - d) ** 2 * mu * mu) / sum(p), 6) AS mean_term, round(sum(p * (1 - d) ** 2) / sum(p), 6) AS residual FROM m")
def band_constants(spark, d):
    """Shares of the power that a low pass leaves, that the mean's loss amounts to, and that it takes away."""
    import math

    basis = F.broadcast(spectra.cosine_basis(spark, 8))  # 8**4 rows
    c = vectors.components_long(_vectors(spark, d)).join(basis, "pos").filter("i + j > 0").groupBy("id", "i", "j").agg(F.sum(F.col("x") * F.col("b")).alias("c"))
    damp = F.exp(-(math.pi**2) * (F.col("i") * F.col("i") + F.col("j") * F.col("j")) / 128)
    m = c.groupBy("i", "j").agg(F.var_pop("c").alias("p"), F.avg("c").alias("mu")).withColumn("d", damp)
    lost = (1 - F.col("d")) * (1 - F.col("d"))
    share = lambda x: F.sum(x) / F.sum("p")
    return _rounded(m.agg(share(F.col("p") * F.col("d") * F.col("d")).alias("inherited"), share(lost * F.col("mu") * F.col("mu")).alias("mean_term"), share(F.col("p") * lost).alias("residual")))


@query(f"WITH {_VEC}, q AS (SELECT * FROM vec WHERE id % 10 = 0), own AS (SELECT q_id, dist FROM {_nn('q', 'vec', 1, 'AND a.grp = b.grp')}), oth AS (SELECT q_id, dist FROM {_nn('q', 'vec', 1, 'AND a.grp <> b.grp')}) SELECT round((SELECT median(dist) FROM own), 6) AS own_mid, round((SELECT median(dist) FROM oth), 6) AS other_mid, round((SELECT quantile_cont(dist, 0.25) FROM oth), 6) AS other_low, round((SELECT quantile_cont(dist, 0.75) FROM oth), 6) AS other_high, (SELECT count(*) FROM own JOIN oth USING (q_id) WHERE own.dist < oth.dist) AS n_own_nearer")
def seed_distances(spark, d):
    """Distances to the nearest of the own and of another group, with quartiles. Queries: ids divisible by ten."""
    v = _vectors(spark, d)
    q = v.filter("id % 10 = 0")
    other = vectors.neighbours(q, v, 1, group="other").select("q_id", F.col("dist").alias("o"))
    mine = vectors.neighbours(q, v, 1, group="own").select("q_id", F.col("dist").alias("m"))
    mid = ranking.quantiles(mine, [], F.col("m"), {"own_mid": 0.5})
    quarter = ranking.quantiles(other, [], F.col("o"), {"other_mid": 0.5, "other_low": 0.25, "other_high": 0.75})
    nearer = mine.join(other, "q_id").agg(F.count_if(F.col("m") < F.col("o")).alias("n_own_nearer"))
    return _rounded(mid.crossJoin(quarter).crossJoin(nearer))  # one row each


@query("WITH p AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.99) AS top FROM lineitem WHERE l_quantity > 5 GROUP BY ALL) SELECT l_returnflag, round(top, 6) AS top, round(avg(least(1, l_extendedprice / top)), 6) AS mean, count(*) FILTER (l_extendedprice >= top) AS n_clipped FROM lineitem JOIN p USING (l_returnflag) GROUP BY ALL")
def scaled_intensity(spark, d):
    """Values over the 99th percentile of the foreground, clipped at one."""
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    top = ranking.quantiles(li.filter("l_quantity > 5"), ["l_returnflag"], F.col("l_extendedprice"), {"top": 0.99})
    j = li.join(top, "l_returnflag")
    return _rounded(j.groupBy("l_returnflag", "top").agg(F.avg(F.least(F.lit(1.0), F.col("l_extendedprice") / F.col("top"))).alias("mean"), F.count_if(F.col("l_extendedprice") >= F.col("top")).alias("n_clipped")))


# ---- scalar forms ---------------------------------------------------------------------------------------------------------------

@query("WITH s AS (SELECT c_custkey, 'c' || c_custkey || ',' || c_mktsegment || ',nation=' || c_nationkey || ',level=' || CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE (c_custkey % 9)::varchar END AS spec FROM customer) SELECT c_custkey, split_part(spec, ',', 2) AS arm, regexp_extract(spec, 'nation=([^,]*)', 1)::int AS nation, try_cast(regexp_extract(spec, 'level=([^,]*)', 1) AS int) AS level FROM s")
def spec_pairs(spark, d):
    """A spec text: a name, an arm, and key=value pairs, whose values take the type of what they replace where they can."""
    c = read_table(spark, d, "customer")
    level = F.when(F.col("c_custkey") % 4 == 0, "x").otherwise((F.col("c_custkey") % 9).cast("string"))
    s = c.select("c_custkey", F.concat(F.lit("c"), "c_custkey", F.lit(","), "c_mktsegment", F.lit(",nation="), "c_nationkey", F.lit(",level="), level).alias("spec"))
    pairs = F.str_to_map("spec", F.lit(","), F.lit("="))
    return s.select("c_custkey", F.split_part("spec", F.lit(","), F.lit(2)).alias("arm"), pairs["nation"].cast("int").alias("nation"), pairs["level"].try_cast("int").alias("level"))


@query("SELECT o_orderkey, printf('%05d', o_orderkey) AS padded, floor(o_totalprice / 1000)::bigint || 'k' AS thousands, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END || o_orderkey AS signed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders")
def formatted_numbers(spark, d):
    o = read_table(spark, d, "orders")
    sign = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    return o.select("o_orderkey", F.format_string("%05d", "o_orderkey").alias("padded"), F.concat(F.floor(F.col("o_totalprice") / 1000), F.lit("k")).alias("thousands"), F.format_string("%+d", sign).alias("signed"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("SELECT p_partkey, round(p_size * 64.0 / 2000, 6) AS epochs, round(1 / (2 * pi() * p_size), 6) AS cycles, round(p_size * sqrt(ln(2)) / pi(), 6) AS half_power FROM part")
def unit_conversions(spark, d):
    import math

    p = read_table(spark, d, "part")
    return _rounded(p.select("p_partkey", (F.col("p_size") * 64.0 / 2000).alias("epochs"), (1 / (2 * math.pi * F.col("p_size"))).alias("cycles"), (F.col("p_size") * math.sqrt(math.log(2)) / math.pi).alias("half_power")))
