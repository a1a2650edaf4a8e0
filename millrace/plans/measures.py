"""Further registered queries, each next to its SQL for DuckDB: bins with their rest, signed octaves, closed forms, invariants that can fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.draws import draw
from millrace.operators import bands, shares, spectra, vectors
from millrace.sources.tables import read_table

from .arrays import _DAMP, SIDE
from .catalog import _power, _rounded, _vectors
from .oracles import _BASIS, _LONG, _OCT, _VEC, _draw, _power as _power_sql, _profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


@query(
    "WITH b AS (SELECT CASE WHEN l_extendedprice < 1600 THEN -1 WHEN l_extendedprice > 51200 THEN 5 WHEN l_extendedprice = 51200 THEN 4 ELSE floor(log2(l_extendedprice / 1600))::int END AS bin FROM lineitem) "
    "SELECT bin, count(*) AS n, sum(count(*)) OVER ()::bigint AS total, true AS adds_up FROM b GROUP BY bin"
)
def binned_totals(spark, d):
    """Counts by bin, with what lies below and above all bins in rows of their own, and whether they add up to the input."""
    price = F.col("l_extendedprice")
    li = read_table(spark, d, "lineitem").select("l_extendedprice")
    inside = spectra.binned(li, spectra.octave_bins(spark, 5, 1600.0), price).groupBy("bin").agg(F.count("*").alias("n"))
    side = F.when(price < 1600, -1).when(price > 51200, 5).cast("int")
    outside = li.select(side.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    both = inside.unionByName(outside)
    totals = both.agg(F.sum("n").alias("total")).crossJoin(li.agg(F.count("*").alias("rows")))  # one row each
    return both.crossJoin(totals).select("bin", "n", "total", (F.col("total") == F.col("rows")).alias("adds_up"))


@query(
    f"WITH {_LONG}, {_BASIS}, {_power_sql('grp = 0', 'pa')}, {_power_sql('grp <> 0', 'pb')}, {_OCT}, {_profile('pa', 'a')}, {_profile('pb', 'b')}, "
    "t AS (SELECT (SELECT sum(power) FROM pa) / (SELECT sum(power) FROM pb) AS ratio) "
    "SELECT bin, round(log10(a.mean_power) - log10(b.mean_power), 6) AS signed, round(ratio, 6) AS variance_ratio FROM a JOIN b USING (bin), t WHERE a.mean_power > 0 AND b.mean_power > 0"
)
def signed_octaves(spark, d):
    """By octave the signed log10 difference of the mean power of the first group and the others, with the ratio of their total variances."""
    v, bins = _vectors(spark, d), spectra.octave_bins(spark, 4)
    power = [bands.mode_power(v.filter(c), "vec", SIDE) for c in ("grp = 0", "grp <> 0")]
    one, two = (spectra.radial_profile(p, bins).select("bin", F.col("mean_power").alias(n)) for p, n in zip(power, "pq", strict=True))
    total = [p.agg(F.sum("power").alias(n)) for p, n in zip(power, "st", strict=True)]
    both = one.join(two, "bin").filter("p > 0 and q > 0").crossJoin(total[0]).crossJoin(total[1])  # one row each
    return _rounded(both.select("bin", (F.log10("p") - F.log10("q")).alias("signed"), (F.col("s") / F.col("t")).alias("variance_ratio")))


_GRID = "bins AS (SELECT k::int AS bin, 0.5 * pow(192.0, k / 48.0) AS lo, 0.5 * pow(192.0, (k + 1) / 48.0) AS hi, k = 47 AS is_last FROM (SELECT unnest(range(48)) AS k))"


@query(f"WITH {_LONG}, {_BASIS}, {_power_sql()}, {_GRID}, {_profile('power', 'm')} SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(n_modes, 0) AS n_modes, round(mean_power, 6) AS mean_power FROM bins LEFT JOIN m USING (bin)")
def grid_profile(spark, d):
    """The mean power on the fixed grid of narrow arrays: 48 bins up to 96 cycles, most of them without a mode here."""
    bins = shares.grid(spark, SIDE)
    told = spectra.radial_profile(_power(spark, d), bins)
    return _rounded(bins.select("bin", "lo", "hi").join(told, "bin", "left").select("bin", "lo", "hi", F.coalesce("n_modes", F.lit(0)).alias("n_modes"), "mean_power"))


@query(
    f"WITH {_LONG}, {_BASIS}, centred AS (SELECT id, grp, pos, x - avg(x) OVER (PARTITION BY id) AS x FROM long), cc AS (SELECT id, grp, i, j, sum(x * b) AS c FROM centred JOIN basis USING (pos) GROUP BY ALL), "
    f"pw AS (SELECT i, j, var_pop(c) AS p, avg(c) AS mu, any_value({_DAMP.format(1.0)}) AS d FROM cc WHERE i + j > 0 GROUP BY i, j), "
    "k AS (SELECT sum(p) AS power, sum(p * d * d) / sum(p) AS predicted, sum((1 - d) * (1 - d) * mu * mu) / sum(p) AS mean_term FROM pw), "
    "w AS (SELECT grp, max(n) AS m, sum(v) / 63 AS div FROM (SELECT grp, pos, count(*) AS n, var_pop(x) AS v FROM centred GROUP BY ALL) GROUP BY grp), "
    "f AS (SELECT grp, m, div * 63 / power AS g, predicted, mean_term FROM w, k) "
    "SELECT grp, round(g, 6) AS fraction, round(1 - m / (m - 1) * g, 6) AS share, round(1 - predicted - g, 6) AS bias, round(mean_term + (1 - predicted) / m, 6) AS bias_expected, round((1 - (1 - m / (m - 1) * g)) / (1 - predicted), 6) AS regenerated FROM f"
)
def closed_shares(spark, d):
    """For each group, read as the samples of one seed: how much of the population's variance it holds, its share, the bias beside the
    predicted share and what that should be, and the variance regenerated, for damping of width 1."""
    v = _vectors(spark, d).withColumn("vec", bands.centred(F.col("vec")))
    square = F.pow(F.floor(F.col("pos") / SIDE), 2) + F.pow(F.col("pos") % SIDE, 2)
    damp = F.exp(-square * float(bands.eigenvalues(SIDE)[0, 1]) / 2)
    mean = F.col("s") / F.col("n")
    modes = bands.mode_sums(v, "vec", SIDE).filter("pos > 0").select(damp.alias("d"), mean.alias("mu"), (F.col("q") / F.col("n") - mean * mean).alias("p"))
    over = lambda x: F.sum(x) / F.sum("p")
    lost = 1 - F.col("d")
    whole = modes.agg(F.sum("p").alias("power"), over(F.col("p") * F.col("d") * F.col("d")).alias("predicted"), over(lost * lost * F.col("mu") * F.col("mu")).alias("mean_term"))
    own = bands.within_group(v, "vec", SIDE, "grp").crossJoin(whole)  # one row
    div, m, power, predicted = (F.col(c) for c in ("diversity", "n", "power", "predicted"))
    share = shares.within_share(div, m, SIDE, power)
    told = {
        "fraction": shares.within_fraction(div, SIDE, power),
        "share": share,
        "bias": shares.bias_fraction(predicted, div, SIDE, power),
        "bias_expected": shares.bias_expected(predicted, F.col("mean_term"), m),
        "regenerated": shares.regeneration(share, predicted),
    }
    return _rounded(own.select("grp", *(c.alias(n) for n, c in told.items())))


@query(
    f"WITH l AS (SELECT c_custkey, row_number() OVER (ORDER BY {_draw(chr(39) + 'distinct' + chr(39), 'c_custkey')}, c_custkey) - 1 AS k FROM customer) "
    "SELECT count(*) AS n, count(DISTINCT c_custkey) AS distinct_n, sha256(string_agg(c_custkey::varchar, ',' ORDER BY k)) AS digest FROM l WHERE k < 50"
)
def distinct_seed_list(spark, d):
    """A list of 50 draws without replacement, pinned by its digest."""
    drawn = read_table(spark, d, "customer").select(draw("distinct", F.col("c_custkey")).alias("h"), "c_custkey").orderBy("h", "c_custkey").limit(50)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "c_custkey"))), lambda x: x["c_custkey"].cast("string")), ",")  # 50 entries
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("distinct_n"), F.sha2(listed, 256).alias("digest"))


@query(f"WITH {_VEC}, q AS (SELECT * FROM vec WHERE id % 100 = 0) SELECT q.id AS a, vec.id AS b, CASE WHEN q.id = vec.id THEN 0.0 ELSE round(list_distance(q.vec, vec.vec), 6) END AS dist FROM q, vec")
def gram_distances(spark, d):
    """Distances from inner products, of the vectors with an id divisible by 100 to all, with an exact zero to themselves."""
    v = _vectors(spark, d)
    return _rounded(vectors.gram_distances(v.filter("id % 100 = 0"), v))


@query(
    "WITH l AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last, count(DISTINCT l_linenumber) AS numbers, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS price FROM lineitem WHERE NOT (l_orderkey % 9 = 0 AND l_linenumber = 1) GROUP BY ALL) "
    "SELECT count(*) AS n_orders, count(*) FILTER (l_orderkey IS NULL) AS n_without_lines, count(*) FILTER (last <> n OR numbers <> n) AS n_gaps, count(*) FILTER (abs(price - o_totalprice) > 0.01 * o_totalprice) AS n_price_off FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"
)
def order_invariants(spark, d):
    """What should hold between orders and their lines, of which some are left out: numbers without a gap, prices that add up."""
    li = read_table(spark, d, "lineitem").filter("not (l_orderkey % 9 = 0 and l_linenumber = 1)")
    price = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_linenumber").alias("last"), F.count_distinct("l_linenumber").alias("numbers"), price.alias("price"))
    both = read_table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    off = F.abs(F.col("price") - F.col("o_totalprice")) > 0.01 * F.col("o_totalprice")
    return both.agg(
        F.count("*").alias("n_orders"),
        F.count_if(F.col("l_orderkey").isNull()).alias("n_without_lines"),
        F.count_if((F.col("last") != F.col("n")) | (F.col("numbers") != F.col("n"))).alias("n_gaps"),
        F.count_if(off).alias("n_price_off"),
    )


#: The keys that a record of each kind has to have, and no others.
KEYS = {"purchase": ["k", "value", "user"], "view": ["k", "user"], "error": ["k", "value"]}


@query(
    "WITH e AS (SELECT event_id, event_type, event_id % 9 = 0 AS short, event_id % 10 = 0 AS long FROM events) "
    "SELECT event_id, event_type, CASE WHEN short AND event_type IN ('purchase', 'error') THEN 'value' WHEN short AND event_type = 'view' THEN 'user' ELSE '' END AS missing, "
    "CASE WHEN event_type NOT IN ('purchase', 'view', 'error') THEN 'unknown kind' WHEN long THEN 'extra' ELSE '' END AS foreign_keys FROM e "
    "WHERE event_type NOT IN ('purchase', 'view', 'error') OR short OR long"
)
def kind_keys(spark, d):
    """Records whose keys are not those of their kind; every kind has its own set, and some have none."""
    e = read_table(spark, d, "events")
    drop = F.when(F.col("event_id") % 9 == 0, F.when(F.col("event_type") == "view", "user").otherwise("value")).otherwise("")
    have = {kind: F.filter(F.array(*map(F.lit, keys)), lambda k: k != drop) for kind, keys in KEYS.items()}
    keys = F.coalesce(*(F.when(F.col("event_type") == kind, have[kind]) for kind in KEYS), F.array(F.lit("k")))
    keys = F.when(F.col("event_id") % 10 == 0, F.array_append(keys, "extra")).otherwise(keys)
    text = F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.lit(1))))
    read = e.select("event_id", "event_type", F.json_object_keys(text).alias("keys"))
    want = F.coalesce(*(F.when(F.col("event_type") == kind, F.array(*map(F.lit, keys))) for kind, keys in KEYS.items()))
    missing, foreign = F.array_join(F.array_sort(F.array_except(want, "keys")), ","), F.array_join(F.array_sort(F.array_except("keys", want)), ",")
    told = read.select("event_id", "event_type", F.coalesce(missing, F.lit("")).alias("missing"), F.when(want.isNull(), "unknown kind").otherwise(foreign).alias("foreign_keys"))
    return told.filter("missing <> '' or foreign_keys <> ''")
