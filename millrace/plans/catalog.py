"""The registered queries of the statistics, curation, vector, spectral and event-log operators, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.draws import draw, r6
from millrace.operators import curation, curves, eventlog, ranking, resampling, spectra, tables, vectors
from millrace.sources.tables import read_table

#: Bootstrap replicates, and permutations of the sampled test.
#: Replicates of a bootstrap, of the gate, and permutations.
N_BOOT, N_GATE, N_PERM = 10_000, 1000, 10_000
ARMS = "event_type"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, user_id, value): the mean value of each user's events of a type."""
    return read_table(spark, d, "events").groupBy(ARMS, "user_id").agg(F.avg("value").alias("value"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, step, v): the mean value by day of the month."""
    e = read_table(spark, d, "events")
    return e.groupBy(ARMS, F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("v"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").alias("grp"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _side(df: DataFrame, salt: str, n: int) -> DataFrame:
    return df.withColumn("side", F.pmod(draw(salt, F.col("id")), F.lit(n)))


def paired_contrast(spark, d):
    c = _cells(spark, d)
    a, b = (c.filter(F.col(ARMS) == x).select("user_id", "value") for x in ("purchase", "view"))
    return _rounded(resampling.contrast(resampling.paired(a, b, "user_id"), [], "user_id", N_BOOT))


def contrast_table(spark, d):
    return _rounded(tables.contrasts(_cells(spark, d), ARMS, "user_id", "view", N_BOOT, 100))


def interaction(spark, d):
    c = _cells(spark, d)
    a, b = (c.filter(F.col(ARMS) == x).select("user_id", "value") for x in ("purchase", "view"))
    deltas = resampling.paired(a, b, "user_id").withColumn("half", F.pmod(draw("half", F.col("user_id")), F.lit(2)))
    point = deltas.groupBy("half").agg(F.avg("delta").alias("m"), F.count("*").alias("n"))
    reps = resampling.resampled_sums(deltas, ["half"], "user_id", ["delta"], N_BOOT).withColumn("m", F.col("delta") / F.col("n"))
    two = reps.groupBy("rep").agg((F.max(F.when(F.col("half") == 0, F.col("m"))) - F.max(F.when(F.col("half") == 1, F.col("m")))).alias("stat"))
    diff = point.agg(F.sum("n").alias("n"), (F.max(F.when(F.col("half") == 0, F.col("m"))) - F.max(F.when(F.col("half") == 1, F.col("m")))).alias("difference"))
    return _rounded(diff.crossJoin(resampling.interval(two, [])))  # one row each


def _nation_means(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.avg("o_totalprice").alias("value"))
    return m.select(F.col("c_nationkey").alias("id"), "value")


def permutation_exact(spark, d):
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    places = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # a dimension of fixed size
    m = o.join(places, o["o_custkey"] == places["c_custkey"]).groupBy(F.col("n_regionkey").alias("id")).agg(F.avg("o_totalprice").alias("value"))
    return _rounded(resampling.exact_permutation(m.withColumn("side", F.when(F.col("id") < 2, "a").otherwise("b"))))


def permutation_sampled(spark, d):
    m = _nation_means(spark, d).withColumn("side", F.when(F.col("id") < 12, "a").otherwise("b"))
    return _rounded(resampling.sampled_permutation(m, N_PERM))


def cluster_bootstrap(spark, d):
    li = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_discount").alias("s"), F.count("*").alias("k"))
    reps = resampling.resampled_sums(li, [], "l_suppkey", ["s", "k"], N_BOOT).withColumn("stat", F.col("s") / F.col("k"))
    point = li.agg(F.count("*").alias("clusters"), (F.sum("s") / F.sum("k")).alias("ratio"))
    return _rounded(point.crossJoin(resampling.interval(reps, [])))  # one row each


def _month_effects(spark, d):
    li = read_table(spark, d, "lineitem").withColumn("month", F.month("l_shipdate"))
    m = li.groupBy("l_returnflag", "l_linestatus", "month").agg(F.avg("l_discount").alias("m"))
    base = m.filter("l_returnflag = 'A'").select("l_linestatus", "month", F.col("m").alias("b"))
    return m.filter("l_returnflag <> 'A'").join(base, ["l_linestatus", "month"]).withColumn("delta", F.col("m") - F.col("b"))


def decomposition(spark, d):
    e = _month_effects(spark, d).withColumn("part", F.concat_ws("/", "l_returnflag", "l_linestatus"))
    out = tables.decomposition(e.select("part", F.col("month").alias("unit"), "delta"), "part", "unit")
    return out.select("part", "n", F.round("delta", 8).alias("delta"), F.round("share", 4).alias("share"))


def transfer_sign(spark, d):
    e = _month_effects(spark, d).groupBy("l_linestatus", F.concat_ws("/", "l_returnflag", F.col("month").cast("string")).alias("endpoint")).agg(F.avg("delta").alias("v"))
    return _rounded(tables.transfer(e, "l_linestatus", "endpoint", "v"))


def design_join_status(spark, d):
    n, c = read_table(spark, d, "nation"), read_table(spark, d, "customer")
    design = n.select("n_name").crossJoin(c.select("c_mktsegment").distinct())  # two dimension tables
    observed = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))
    return tables.design_status(design, observed.filter("n >= 5"), ["n_name", "c_mktsegment"], "n_name")


def _last_view(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col(ARMS) == "view").agg(F.max(F.struct("step", "v"))["v"].alias("thr"))


def first_crossing(spark, d):
    daily = _daily(spark, d)
    placed = daily.crossJoin(F.broadcast(_last_view(daily)))  # one row
    return curves.first_crossing(placed, ARMS, F.col("thr"))


def settling_step(spark, d):
    daily = _daily(spark, d)
    top = daily.groupBy(ARMS).agg(F.percentile("v", 0.9).alias("thr"))
    return curves.settling_step(daily.join(top, ARMS), ARMS, F.col("thr"))


def plateau_step(spark, d):
    return _rounded(curves.plateau_step(_daily(spark, d), ARMS, 3.0, 5))


def running_mean(spark, d):
    return _rounded(curves.running_mean(_daily(spark, d), ARMS, 5))


def curve_summary(spark, d):
    return _rounded(curves.peak(_daily(spark, d), ARMS))


def schedule_check(spark, d):
    return curves.increasing(_daily(spark, d), ARMS, "step", "v")


def components_for_share(spark, d):
    o = read_table(spark, d, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return curves.reaches_share(o.withColumn("v", F.round("v", 2).cast("decimal(18,2)").cast("double")), "o_orderpriority", "o_custkey", "v", 0.5)


def within_group_corr(spark, d):
    li = read_table(spark, d, "lineitem")
    means = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mq"), F.avg("l_extendedprice").alias("mp"))
    c = li.join(means, "l_suppkey").select((F.col("l_quantity") - F.col("mq")).alias("q"), (F.col("l_extendedprice") - F.col("mp")).alias("p"), "l_quantity", "l_extendedprice")
    return _rounded(c.agg(F.corr("q", "p").alias("within"), F.corr("l_quantity", "l_extendedprice").alias("overall")))


def loglog_slope(spark, d):
    from pyspark.sql import Window

    f = read_table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    by_size = f.groupBy("n").agg(F.count("*").alias("parts"))
    later = F.sum("parts").over(Window.partitionBy().orderBy(F.desc("n")))
    ranks = by_size.select("n", later.alias("rank"))
    return _rounded(ranks.agg(F.count("*").alias("points"), (-F.regr_slope(F.log("n"), F.log("rank"))).alias("alpha")))


def entity_split(spark, d):
    return curation.entity_split(read_table(spark, d, "customer").select("c_custkey"), "c_custkey", "split", 0.8, 5)


def stratified_split(spark, d):
    c = read_table(spark, d, "customer")
    out = curation.stratified_split(c.select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 101, "strata")
    return out.groupBy("c_mktsegment", "split").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


def _order_splits(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(entity_split(spark, d), "c_custkey", "left")


def leakage_check(spark, d):
    # Every fiftieth order is put into a split of its own, which the check has to find.
    o = _order_splits(spark, d).withColumn("split", F.when(F.col("o_orderkey") % 50 == 0, "moved").otherwise(F.col("split")))
    per = o.groupBy("c_custkey").agg(F.count_distinct("split").alias("k"))
    return per.agg(F.count("*").alias("entities"), F.count_if(F.col("k") > 1).alias("leaks"))


def partition_check(spark, d):
    o = _order_splits(spark, d)
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("split").isNull()).alias("unassigned"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "seed").alias("n_seed"))


def mad_gate(spark, d):
    return _rounded(curation.mad_gate(read_table(spark, d, "supplier"), "s_suppkey", "s_acctbal"))


def exact_dedup(spark, d):
    return curation.exact_dedup(read_table(spark, d, "documents"), "doc_id", F.col("text"))


def rejection_counts(spark, d):
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") > 10000, "long").otherwise("ok")
    return curation.rejections(read_table(spark, d, "documents"), "source", reason)


def accept_first_n(spark, d):
    return curation.accept_first(read_table(spark, d, "documents"), "doc_id", F.col("n_chars") >= 200, F.col("text"), 100)


def knn(spark, d):
    v = _vectors(spark, d)
    return _rounded(vectors.neighbours(v.filter("id % 100 = 0"), v, 5))


def knn_other_group(spark, d):
    v = _vectors(spark, d)
    return _rounded(vectors.neighbours(v.filter("id % 100 = 0"), v, 1, group="other"))


def _with_copies(spark, d):
    """The vectors and, with ids from 100,000 on, nearly the same again for every 25th."""
    v = _vectors(spark, d)
    near = v.filter("id % 25 = 0").select((F.col("id") + 100_000).alias("id"), F.transform("vec", lambda x, i: F.when(i == 7, x + 0.05).otherwise(x)).alias("vec"), "grp")
    return v.unionByName(near)


def near_dup_pairs(spark, d):
    return _rounded(vectors.near_pairs(_with_copies(spark, d), 0.9))


def near_dup_screen(spark, d):
    v = _with_copies(spark, d)
    hit = vectors.near_earlier(v, 0.9)
    return v.join(hit.withColumn("x", F.lit(1)), "id", "left").groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNotNull()).alias("n_near"))


def memorisation_ratio(spark, d):
    v = _side(_vectors(spark, d), "mem", 3)
    train = v.filter("side = 0")
    near = [ranking.quantiles(vectors.neighbours(v.filter(f"side = {s}"), train, 1), [], F.col("dist"), {n: 0.5}) for s, n in ((1, "held"), (2, "sample"))]
    both = near[0].crossJoin(near[1])  # one row each
    return _rounded(both.select("held", "sample", (F.col("sample") / F.col("held")).alias("ratio")))


def prdc(spark, d):
    v = _side(_vectors(spark, d), "prdc", 2)
    return _rounded(vectors.prdc(v.filter("side = 0"), v.filter("side = 1"), 5))


def intrinsic_dim(spark, d):
    return _rounded(vectors.intrinsic_dimension(_vectors(spark, d), 10))


def participation_ratio(spark, d):
    c = vectors.covariance(_vectors(spark, d))
    tr, sq = F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))), F.sum(F.col("c") * F.col("c"))
    return _rounded(c.agg(tr.alias("trace"), (tr * tr / sq).alias("ratio")))


def group_diversity(spark, d):
    long = vectors.components_long(_vectors(spark, d))
    per = long.groupBy("grp", "pos").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    return _rounded(per.groupBy("grp").agg(F.max("n").alias("n"), (F.sum("v") / (F.count("*") - 1)).alias("diversity")))


def _power(spark, d, group=()):
    return spectra.mode_power(vectors.components_long(_vectors(spark, d)), 8, list(group))


def mode_power(spark, d):
    return _power(spark, d).select("i", "j", F.round("power", 6).alias("power"))


def octave_shares(spark, d):
    return _rounded(spectra.octave_shares(_power(spark, d).filter("i + j > 0"), spectra.octave_bins(spark, 4)))


def radial_profile(spark, d):
    return _rounded(spectra.radial_profile(_power(spark, d), spectra.octave_bins(spark, 4)))


def log_spectral_distance(spark, d):
    bins = spectra.octave_bins(spark, 4)
    v = _vectors(spark, d)
    one, two = (spectra.radial_profile(spectra.mode_power(vectors.components_long(v.filter(c)), 8, []), bins) for c in ("grp = 0", "grp <> 0"))
    return _rounded(spectra.log_distance(one, two))


def low_pass_share(spark, d):
    return _rounded(spectra.low_pass_share(_power(spark, d), 8, 1.0))


def histogram(spark, d):
    return _rounded(tables.zero_filled_histogram(read_table(spark, d, "lineitem"), F.col("l_quantity"), 0, 60))


def bin_counts(spark, d):
    bins = spectra.octave_bins(spark, 7, 100.0)
    li = read_table(spark, d, "lineitem")
    return spectra.binned(li, bins, F.col("l_extendedprice")).groupBy("bin").agg(F.count("*").alias("n"))


def majority_drift(spark, d):
    return eventlog.majority(read_table(spark, d, "lineitem"), "l_suppkey", "l_returnflag")


def step_windows(spark, d):
    e = eventlog.step_windows(read_table(spark, d, "events"), "event_id", 50)
    w = e.groupBy("window").agg(F.count("*").alias("n"), F.count_if(F.col(ARMS) == "error").alias("n_error"), F.avg(F.when(F.col(ARMS) != "error", F.col("value"))).alias("mean_value"))
    return _rounded(w)


def rewind_canonical(spark, d):
    e = read_table(spark, d, "events").withColumn("step", F.get_json_object("props", "$.k").cast("int"))
    kept = eventlog.rewound(e, "user_id", "event_id", F.col(ARMS) == "error", F.col("step"))
    return kept.groupBy("user_id").agg(F.count("*").alias("n_kept"), F.count_if(F.col(ARMS) == "error").alias("n_resumes"), F.sum("event_id").alias("id_sum"))


def failure_streaks(spark, d):
    return curves.streaks(read_table(spark, d, "events"), "user_id", "event_id", F.col(ARMS) == "error")


def cadence_check(spark, d):
    rows = read_table(spark, d, "conversations").filter("(conv_id * 7 + turn) % 11 <> 0")  # some turns are left out
    return eventlog.cadence(rows, "conv_id", "turn")


def terminal_event(spark, d):
    last = F.max(F.struct("event_id", ARMS))
    return read_table(spark, d, "events").groupBy("user_id").agg(last[ARMS].alias("last_type"), last["event_id"].alias("last_id"))


def json_flatten(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def schema_rules(spark, d):
    props = F.when(F.col("event_id") % 7 == 0, '{"k": 1, "more": 2}').when(F.col("event_id") % 11 == 0, "{}").otherwise(F.col("props"))  # some with other keys
    e = read_table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 13 == 0, -1.0).otherwise(F.col("value")))
    e = e.withColumn("bad", F.size(eventlog.key_violations(props, ["k"])) > 0)
    value_bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0)
    return e.groupBy(ARMS).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad_keys"), F.count_if(value_bad).alias("bad_values"))


def reconcile_sources(spark, d):
    li = read_table(spark, d, "lineitem")
    wide = li.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    long = li.groupBy("l_suppkey", F.col("l_returnflag").alias("metric")).agg(F.sum("l_quantity").alias("value"))
    # The other source has some values off and lacks some.
    off = (F.col("metric") == "N") & (F.col("l_suppkey") % 3 == 0)
    long = long.filter("not (metric = 'A' and l_suppkey % 4 = 0)").withColumn("value", F.when(off, F.col("value") * 1.001).otherwise(F.col("value")))
    return tables.reconcile(wide, long, "l_suppkey")


def wide_index(spark, d):
    e = _cells(spark, d).groupBy("user_id").pivot(ARMS, ["click", "error", "purchase", "signup", "view"]).agg(F.first("value"))
    return _rounded(e)


def grouped_summary(spark, d):
    orders = read_table(spark, d, "orders")
    med = ranking.quantiles(orders, ["o_orderpriority"], F.col("o_totalprice"), {"med": 0.5})
    o = orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
        F.stddev_samp("o_totalprice").alias("sd"), F.stddev_pop("o_totalprice").alias("sd_pop"),
        F.count_distinct("o_custkey").alias("customers"), F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"))
    return _rounded(o.join(med, "o_orderpriority"))


def multiplicity(spark, d):
    k = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return k.agg(F.sum("k").alias("n"), F.count("*").alias("distinct_keys"), F.max("k").alias("most"), F.count_if(F.col("k") > 1).alias("repeated"))


def config_diff(spark, d):
    c = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("a"))
    s = read_table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("b"))
    both = c.join(s, c["c_nationkey"] == s["s_nationkey"], "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("key"), "a", "b")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def held_out_anti(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = read_table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("key_sum"))


def contamination(spark, d):
    b = read_table(spark, d, "benchmark")
    docs = read_table(spark, d, "documents").select("doc_id", "text").unionByName(b.filter("item_id % 3 = 0").select((-F.col("item_id") - 1).alias("doc_id"), "text"))  # some that are items
    return docs.withColumn("h", F.sha2("text", 256)).join(b.select(F.sha2("text", 256).alias("h")), "h", "left_semi").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def union_conflicts(spark, d):
    a = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("v"))
    return a.groupBy("key").agg(F.count_distinct("v").alias("k")).agg(F.count("*").alias("keys"), F.count_if(F.col("k") > 1).alias("conflicts"))


def batches(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), draw("shuffle", F.col("o_orderkey")).alias("h"))
    b = ranking.numbered(o, ["y"], ["h", "o_orderkey"]).withColumn("batch", F.floor(F.col("i") / 64) + 1)
    return b.groupBy("y", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least")).filter("n = 64")


def frechet_distance(spark, d):
    v = _side(_vectors(spark, d), "frechet", 2)
    return spark.createDataFrame([(round(vectors.frechet(v.filter("side = 0"), v.filter("side = 1")), 6),)], "distance double")


def kernel_distance(spark, d):
    v = _side(_vectors(spark, d), "frechet", 2)
    return _rounded(vectors.kernel_distance(v.filter("side = 0"), v.filter("side = 1")))


def pca_scores(spark, d):
    return _rounded(vectors.principal_scores(_vectors(spark, d), 3))


QUERIES = {f.__name__: f for f in (
    paired_contrast, contrast_table, interaction, permutation_exact, permutation_sampled, cluster_bootstrap, decomposition, transfer_sign,
    design_join_status, first_crossing, settling_step, plateau_step, running_mean, curve_summary, schedule_check, components_for_share,
    within_group_corr, loglog_slope, entity_split, stratified_split, leakage_check, partition_check, mad_gate, exact_dedup, rejection_counts,
    accept_first_n, knn, knn_other_group, near_dup_pairs, near_dup_screen, memorisation_ratio, prdc, intrinsic_dim, participation_ratio,
    group_diversity, mode_power, octave_shares, radial_profile, log_spectral_distance, low_pass_share, histogram, bin_counts, majority_drift,
    step_windows, rewind_canonical, failure_streaks, cadence_check, terminal_event, json_flatten, schema_rules, reconcile_sources, wide_index,
    grouped_summary, multiplicity, config_diff, held_out_anti, contamination, union_conflicts, batches, frechet_distance, kernel_distance, pca_scores,
)}
