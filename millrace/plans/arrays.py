"""Registered queries on vectors that are read as square arrays, each next to its SQL for DuckDB.

Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import bands, lowrank, ranking, spectra, vectors

from .catalog import _rounded, _side, _vectors
from .oracles import _BASIS, _IN, _LONG, _OCT, _VEC, _draw, _nn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIDE = 8


def query(sql: str = ""):
    """Register a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_COEF = "coef AS (SELECT id, grp, i, j, sum(x * b) AS c FROM long JOIN basis USING (pos) GROUP BY ALL)"
_DAMP = "exp(-pi() * pi() * (i * i + j * j) / 64 * {0} * {0} / 2)"


def _passed(sigma: float, source: str = "long", name: str = "passed") -> str:
    """(id, grp, pos, x): the arrays of ``source`` after heat."""
    return (
        f"{name}_c AS (SELECT id, grp, i, j, sum(x * b) * any_value({_DAMP.format(sigma)}) AS c FROM {source} JOIN basis USING (pos) GROUP BY ALL), "
        f"{name} AS (SELECT id, grp, pos, sum(c * b) AS x FROM {name}_c JOIN basis USING (i, j) GROUP BY ALL)"
    )


_CENTRED = "centred AS (SELECT id, grp, pos, x - avg(x) OVER (PARTITION BY id) AS x FROM long)"


@query(f"WITH {_LONG}, {_BASIS}, {_passed(1.0)} SELECT id, pos, round(x, 6) AS x FROM passed")
def heat_low_pass(spark, d):
    """Every vector after heat of width 1 cell."""
    v = _vectors(spark, d)
    return _rounded(v.select("id", F.posexplode(bands.low_pass(F.col("vec"), SIDE, 1.0)).alias("pos", "x")))


_WITHIN = "(SELECT grp, max(n) AS n, sum(v) / 63 AS d FROM (SELECT grp, pos, count(*) AS n, var_pop(x) AS v FROM {} GROUP BY ALL) GROUP BY grp)"


@query(
    f"WITH {_LONG}, {_BASIS}, {_CENTRED}, {_passed(1.0, 'centred')}, raw AS {_WITHIN.format('centred')}, low AS {_WITHIN.format('passed')} "
    "SELECT grp, raw.n, round(raw.d, 6) AS diversity, round(low.d, 6) AS diversity_low, round(avg(raw.d) OVER (), 6) AS mean, round(avg(low.d) OVER (), 6) AS mean_low FROM raw JOIN low USING (grp)"
)
def seed_diversity(spark, d):
    """The diversity within each group, of the vectors without their means and of what passes heat of width 1, with the mean over the groups."""
    v = _vectors(spark, d).withColumn("vec", bands.centred(F.col("vec")))
    raw = bands.within_group(v, "vec", SIDE, "grp")
    low = bands.within_group(v.withColumn("low", bands.low_pass(F.col("vec"), SIDE, 1.0)), "low", SIDE, "grp").withColumnsRenamed({"n": "m", "diversity": "diversity_low"})
    both = raw.join(low, "grp").drop("m")
    means = both.agg(F.avg("diversity").alias("mean"), F.avg("diversity_low").alias("mean_low"))
    return _rounded(both.crossJoin(means))  # one row of means


def _listed(source: str, name: str) -> str:
    return f"{name} AS (SELECT id, any_value(grp) AS grp, list(x ORDER BY pos) AS vec, any_value({_draw(chr(39) + 'mem' + chr(39), 'id')} % 3) AS side FROM {source} GROUP BY id)"


def _ratio(source: str, name: str) -> str:
    return (
        f"{name}_t AS (SELECT * FROM {source} WHERE side = 0), {name}_q AS (SELECT * FROM {source} WHERE side > 0), {name}_n AS {_nn(name + '_q', name + '_t', 1)}, "
        f"{name} AS (SELECT median(dist) FILTER (q.side = 1) AS held, median(dist) FILTER (q.side = 2) AS sample, avg((q.grp = t.grp)::int) FILTER (q.side = 2) AS own FROM {name}_n JOIN {name}_q q ON q.id = q_id JOIN {name}_t t ON t.id = c_id)"
    )


@query(
    f"WITH {_LONG}, {_BASIS}, {_CENTRED}, {_passed(1.0, 'centred')}, {_listed('centred', 'a')}, {_listed('passed', 'b')}, {_ratio('a', 'raw')}, {_ratio('b', 'low')} "
    "SELECT round(raw.held, 6) AS held, round(raw.sample, 6) AS sample, round(raw.sample / raw.held, 6) AS ratio, round(raw.own, 6) AS own_share, "
    "round(low.held, 6) AS held_low, round(low.sample, 6) AS sample_low, round(low.sample / low.held, 6) AS ratio_low, round(low.own, 6) AS own_share_low FROM raw, low"
)
def memorisation_low_passed(spark, d):
    """Median distances to the nearest training vector, of held-out vectors and of samples, their ratio, and how often it is of the sample's own
    group: for vectors without their means, and for what passes heat of width 1."""

    def told(v: DataFrame, end: str) -> DataFrame:
        train = v.filter("side = 0")
        near = vectors.neighbours(v.filter("side > 0"), train, 1).join(v.select(F.col("id").alias("q_id"), "side", F.col("grp").alias("q_grp")), "q_id")
        near = near.join(train.select(F.col("id").alias("c_id"), F.col("grp").alias("c_grp")), "c_id")
        middle = ranking.quantiles(near, ["side"], F.col("dist"), {"m": 0.5})
        at = lambda s: F.max(F.when(F.col("side") == s, F.col("m")))
        own = near.filter("side = 2").agg(F.avg((F.col("q_grp") == F.col("c_grp")).cast("double")).alias(f"own_share{end}"))
        both = middle.agg(at(1).alias(f"held{end}"), at(2).alias(f"sample{end}")).crossJoin(own)  # one row each
        return both.withColumn(f"ratio{end}", F.col(f"sample{end}") / F.col(f"held{end}"))

    v = _side(_vectors(spark, d).withColumn("vec", bands.centred(F.col("vec"))), "mem", 3)
    return _rounded(told(v, "").crossJoin(told(v.withColumn("vec", bands.low_pass(F.col("vec"), SIDE, 1.0)), "_low")))  # one row each


_SEEDED = (
    f"WITH {_LONG}, {_BASIS}, {_CENTRED}, cc AS (SELECT id, grp, i, j, sum(x * b) AS c FROM centred JOIN basis USING (pos) GROUP BY ALL), "
    "first AS (SELECT grp, min(id) AS id FROM vec GROUP BY grp), seed AS (SELECT cc.* FROM cc JOIN first USING (id)), "
    f"res AS (SELECT a.i, a.j, avg(power(a.c - {_DAMP.format(2.0).replace('i * i', 'a.i * a.i').replace('j * j', 'a.j * a.j')} * s.c, 2)) AS v FROM cc a JOIN seed s USING (grp, i, j) WHERE a.id <> s.id GROUP BY a.i, a.j), "
    "pw AS (SELECT i, j, var_pop(c) AS p FROM cc GROUP BY i, j), "
    "m AS (SELECT i, j, v, p, 1 - exp(-pi() * pi() * (i * i + j * j) / 64 * 4) AS predicted, pi() * pi() * (i * i + j * j) / 64 <= 2 / (1.5 * 1.5) AS low FROM res JOIN pw USING (i, j) WHERE i + j > 0)"
)


@query(
    f"{_SEEDED}, {_OCT}, s AS (SELECT 1 - sum(v) / sum(p) AS a, sum(p * (1 - predicted)) / sum(p) AS b, 1 - sum(v) FILTER (low) / sum(p) FILTER (low) AS c, sum(p * (1 - predicted)) FILTER (low) / sum(p) FILTER (low) AS d FROM m) "
    f"SELECT bin, count(*) AS n_modes, round(avg(v / p), 6) AS measured, round(avg(predicted), 6) AS predicted, round(any_value(a), 6) AS share_measured, round(any_value(b), 6) AS share_predicted, round(any_value(c), 6) AS low_measured, round(any_value(d), 6) AS low_predicted FROM m JOIN bins ON {_IN}, s GROUP BY bin"
)
def inherited_band(spark, d):
    """By octave, how far vectors are from their seed (their group's first vector) after damping of width 2, measured against predicted; with
    the shares over all modes and over those of a width of 1.5 cells or more."""
    v = _vectors(spark, d).withColumnRenamed("grp", "key")
    first = v.groupBy("key").agg(F.min("id").alias("id"))
    seeds = v.join(first, ["key", "id"]).select("key", "vec")
    samples = v.join(first, ["key", "id"], "left_anti").select("key", "vec")
    power = bands.mode_power(v.withColumn("vec", bands.centred(F.col("vec"))), "vec", SIDE)
    whole, low = (bands.inherited(samples, seeds, power, SIDE, 2.0, width) for width in (None, 1.5))
    by_bin = spectra.binned(whole.filter("i + j > 0"), spectra.octave_bins(spark, 4), spectra.radius()).groupBy("bin")
    profile = by_bin.agg(F.count("*").alias("n_modes"), F.avg("measured").alias("measured"), F.avg("predicted").alias("predicted"))
    shares = bands.inherited_shares(low).withColumnsRenamed({"share_measured": "low_measured", "share_predicted": "low_predicted"})
    return _rounded(profile.crossJoin(bands.inherited_shares(whole)).crossJoin(shares))  # one row each


@query(
    f"WITH {_LONG}, {_BASIS}, {_COEF}, r AS (SELECT *, sqrt(i * i + j * j) / 2 AS r FROM coef), "
    "b AS (SELECT id, CASE WHEN r = 0 THEN 3 WHEN r < 1 THEN 0 WHEN r < 2 THEN 1 WHEN r <= 4 THEN 2 ELSE 4 END AS part, c FROM r) "
    "SELECT id, part, round(sum(c * c), 6) AS energy, 0.0::DOUBLE AS gap FROM b GROUP BY ALL"
)
def band_energies(spark, d):
    """The energy of each part of a vector (its octaves, its mean, its corner modes), and how far the parts are from adding up to it."""
    v = _vectors(spark, d).withColumn("parts", bands.parts(F.col("vec"), SIDE))
    whole = F.aggregate(F.col("parts"), F.transform("vec", lambda x: F.lit(0.0)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y))
    gap = F.array_max(F.zip_with(whole, F.col("vec"), lambda x, y: F.abs(x - y)))
    each = v.select("id", gap.alias("gap"), F.posexplode("parts").alias("part", "x"))
    return _rounded(each.select("id", "part", F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x).alias("energy"), "gap"))


@query(
    f"WITH {_LONG}, a AS (SELECT id, min(pos // 8) AS r0, max(pos // 8) AS r1, min(pos % 8) AS c0, max(pos % 8) AS c1 FROM long WHERE x > 0.2 GROUP BY id), "
    "s AS (SELECT *, greatest(r1 - r0, c1 - c0) + 1 AS size FROM a), "
    "w AS (SELECT id, size, least(greatest(floor((r0 + r1 + 1 - size) / 2.0), 0), 8 - size) AS r, least(greatest(floor((c0 + c1 + 1 - size) / 2.0), 0), 8 - size) AS c FROM s) "
    "SELECT vec.id, coalesce(r, 0)::int AS row0, coalesce(r + size, 8)::int AS row1, coalesce(c, 0)::int AS col0, coalesce(c + size, 8)::int AS col1 FROM vec LEFT JOIN w USING (id)"
)
def mask_windows(spark, d):
    """The square around the values above 0.2."""
    return _vectors(spark, d).select("id", bands.window(F.col("vec"), SIDE, 0.2).alias("w")).select("id", "w.*")


@query(
    f"WITH {_LONG}, p AS (SELECT id, (pos // 16) * 4 + (pos % 8) // 2 AS cell, avg(x) AS x FROM long GROUP BY ALL), c AS (SELECT id, cell, x - avg(x) OVER (PARTITION BY id) AS x FROM p) "
    "SELECT id, cell::int AS cell, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM c"
)
def square_thumbnails(spark, d):
    """Means of 2 x 2 values, centred and of length one."""
    return _rounded(_vectors(spark, d).select("id", F.posexplode(bands.thumbnail(F.col("vec"), SIDE, 4)).alias("cell", "x")))


# ---- components and distances between sets of features ----------------------------------------------------------

_MATRIX = "SELECT list(row ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS row FROM {} GROUP BY i)"
_TIMES = "list_transform({0}, lambda r: list_dot_product(r, {1}))"


def _leading(matrix: str, name: str, rounds: int = 4000) -> str:
    """CTEs: the leading eigenvector v and value of a symmetric matrix (m, one row), by power iteration, its largest loading positive."""
    return (
        f"{name}_it AS (SELECT 0 AS k, list_transform(range(64), lambda i: (1.0 + 0.37 * ((i * 29) % 64))::DOUBLE) AS v UNION ALL "
        f"SELECT k + 1, list_transform(y, lambda a: a / sqrt(list_dot_product(y, y))) FROM (SELECT k, {_TIMES.format('m', 'v')} AS y FROM {name}_it, {matrix} WHERE k < {rounds})), "
        f"{name}_u AS (SELECT v FROM {name}_it WHERE k = {rounds}), "
        f"{name}_s AS (SELECT list_transform(v, lambda a: a * sign(v[list_position(list_transform(v, lambda b: abs(b)), list_max(list_transform(v, lambda b: abs(b))))])) AS v FROM {name}_u), "
        f"{name} AS (SELECT v, list_dot_product(v, {_TIMES.format('m', 'v')}) AS value FROM {name}_s, {matrix})"
    )


_DEFLATED = "d AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - value * v[i] * v[j])) AS m FROM c, one)"


@query(
    f"WITH RECURSIVE {_LONG}, {_CENTRED}, t AS (SELECT id, {_draw(chr(39) + 'pca' + chr(39), 'id')} % 3 AS side, list(x ORDER BY pos) AS vec FROM centred GROUP BY id), "
    "mean AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM centred JOIN t USING (id) WHERE side = 0 GROUP BY pos)), "
    "z AS (SELECT t.id, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x, i: x - mean[i])) AS x FROM t, mean WHERE side = 0), "
    "cov AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM z a JOIN z b USING (id) GROUP BY ALL), "
    f"c AS ({_MATRIX.format('cov')}), {_leading('c', 'one')}, {_DEFLATED}, {_leading('d', 'two')} "
    "SELECT side, id, round(list_dot_product(list_transform(vec, lambda x, i: x - mean[i]), one.v), 6) AS pc1, round(list_dot_product(list_transform(vec, lambda x, i: x - mean[i]), two.v), 6) AS pc2, "
    "round(one.value, 6) AS var1, round(two.value, 6) AS var2 FROM t, mean, one, two"
)
def pca_three_sets(spark, d):
    """Training vectors, seeds and samples on the two leading components of the training vectors, all without their own means."""
    v = _side(_vectors(spark, d).withColumn("vec", bands.centred(F.col("vec"))), "pca", 3)
    found = lowrank.components(v.filter("side = 0"), 2, oversampling=SIDE * SIDE)  # the whole width: exact
    scored = v.select("side", "id", found.scores(F.col("vec"), spark).alias("pc"))
    return _rounded(scored.select("side", "id", *(F.col("pc")[k].alias(f"pc{k + 1}") for k in range(2)), *(F.lit(float(found.variance[k])).alias(f"var{k + 1}") for k in range(2))))


@query()
def spectrum_rank(spark, d):
    """The rank of the vectors' covariance, the components for nine tenths of its variance, its total and its participation ratio."""
    c = lowrank.components(_vectors(spark, d), SIDE * SIDE, oversampling=0)  # all of them: exact
    ratio = float(c.variance.sum() ** 2 / (c.variance**2).sum())
    return spark.createDataFrame([(c.n, c.rank(), c.for_share(0.9), round(c.total, 6), round(ratio, 6))], "n bigint, rank int, for_share int, total double, participation double")


_FEATURES = f"{_VEC}, s AS (SELECT id, vec, {_draw(chr(39) + 'frechet' + chr(39), 'id')} % 2 AS side FROM vec)"
_DRAWN = (
    "a AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM s WHERE side = 0), b AS (SELECT * FROM s WHERE side = 1), "
    f"w AS (SELECT 0 AS rep, i, 1 AS w FROM a UNION ALL SELECT rep, i, count(*) AS w FROM (SELECT rep, {_draw(chr(39) + 'features' + chr(39), 'rep', 'i')} % n AS i FROM a, (SELECT unnest(range(1, 201)) AS rep)) GROUP BY ALL)"
)
_SUMMARY = "SELECT round(any_value(distance) FILTER (rep = 0), 6) AS distance, round(quantile_cont(distance, 0.025) FILTER (rep > 0), 6) AS ci_low, round(quantile_cont(distance, 0.975) FILTER (rep > 0), 6) AS ci_high, count(*) FILTER (rep > 0) AS n_boot FROM {}"


def _times(a: str, b: str) -> str:
    """The product of two square matrices that are lists of rows."""
    return f"list_transform({a}, lambda r: list_transform(range(1, 17), lambda j: list_dot_product(r, list_transform({b}, lambda q: q[j]))))"


_IDENTITY = "list_transform(range(16), lambda i: list_transform(range(16), lambda j: (i = j)::int::double))"


@query(
    f"WITH RECURSIVE {_FEATURES}, {_DRAWN}, xa AS (SELECT i, unnest(range(16)) AS pos, unnest(vec[1:16]) AS x FROM a), xb AS (SELECT id, unnest(range(16)) AS pos, unnest(vec[1:16]) AS x FROM b), "
    "ma AS (SELECT rep, pos, sum(w * x) / sum(w) AS m FROM w JOIN xa USING (i) GROUP BY ALL), mb AS (SELECT pos, avg(x) AS m FROM xb GROUP BY pos), "
    "ca AS (SELECT rep, p.pos AS i, q.pos AS j, (sum(w * p.x * q.x) - sum(w) * any_value(k.m) * any_value(l.m)) / (sum(w) - 1) AS c FROM w JOIN xa p USING (i) JOIN xa q USING (i) JOIN ma k USING (rep) JOIN ma l USING (rep) WHERE k.pos = p.pos AND l.pos = q.pos GROUP BY rep, p.pos, q.pos), "
    "cb AS (SELECT p.pos AS i, q.pos AS j, covar_samp(p.x, q.x) AS c FROM xb p JOIN xb q USING (id) GROUP BY ALL), "
    "la AS (SELECT rep, list(row ORDER BY i) AS m FROM (SELECT rep, i, list(c ORDER BY j) AS row FROM ca GROUP BY rep, i) GROUP BY rep), "
    f"lb AS ({_MATRIX.format('cb')}), "
    f"pr AS (SELECT rep, {_times('la.m', 'lb.m')} AS m FROM la, lb), "
    "sc AS (SELECT rep, list_sum(list_transform(m, lambda r, i: r[i])) AS t, m FROM pr), "
    # The square root's trace by Newton's iteration on the product over its trace: y goes to the root, z to its inverse.
    f"it AS (SELECT 0 AS k, rep, t, list_transform(m, lambda r: list_transform(r, lambda x: x / t)) AS y, {_IDENTITY} AS z FROM sc UNION ALL "
    f"SELECT k + 1, rep, t, {_times('y', 'h')}, {_times('h', 'z')} FROM (SELECT k, rep, t, y, z, list_transform({_times('z', 'y')}, lambda r, i: list_transform(r, lambda x, j: 1.5 * (i = j)::int - 0.5 * x)) AS h FROM it WHERE k < 30)), "
    "tr AS (SELECT rep, sqrt(t) * list_sum(list_transform(y, lambda r, i: r[i])) AS tr FROM it WHERE k = 30), "
    "dm AS (SELECT rep, sum(power(ma.m - mb.m, 2)) AS d FROM ma JOIN mb USING (pos) GROUP BY rep), da AS (SELECT rep, sum(c) AS t FROM ca WHERE i = j GROUP BY rep), db AS (SELECT sum(c) AS t FROM cb WHERE i = j), "
    f"f AS (SELECT rep, d + da.t + db.t - 2 * tr AS distance FROM dm JOIN da USING (rep) JOIN tr USING (rep), db) {_SUMMARY.format('f')}"
)
def frechet_bootstrap(spark, d):
    """The Fréchet distance of the vectors' first 16 features on two sides, with the interval of 200 replicates of one side."""
    v = _side(_vectors(spark, d), "frechet", 2).withColumn("vec", F.slice("vec", 1, 16))
    return _rounded(lowrank.summary(lowrank.bootstrap_frechet(v.filter("side = 0"), v.filter("side = 1"), 200)))


_KERNEL = "power(list_dot_product({0}, {1}) / 64 + 1, 3)"


@query(
    f"WITH {_FEATURES}, {_DRAWN}, kaa AS (SELECT p.i AS i, q.i AS j, {_KERNEL.format('p.vec', 'q.vec')} AS k FROM a p, a q), kab AS (SELECT a.i, sum({_KERNEL.format('a.vec', 'b.vec')}) AS k FROM a, b GROUP BY a.i), "
    f"kbb AS (SELECT sum({_KERNEL.format('p.vec', 'q.vec')}) AS k FROM b p, b q WHERE p.id <> q.id), "
    "aa AS (SELECT u.rep, sum(u.w * v.w * k) - sum(CASE WHEN u.i = v.i THEN u.w * k ELSE 0 END) AS s FROM w u JOIN w v USING (rep) JOIN kaa ON kaa.i = u.i AND kaa.j = v.i GROUP BY u.rep), "
    "ab AS (SELECT rep, sum(w * k) AS s FROM w JOIN kab USING (i) GROUP BY rep), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb), "
    f"f AS (SELECT rep, aa.s / (na * (na - 1)) + kbb.k / (nb * (nb - 1)) - 2 * ab.s / (na * nb) AS distance FROM aa JOIN ab USING (rep), kbb, n) {_SUMMARY.format('f')}"
)
def kernel_bootstrap(spark, d):
    """The kernel distance of two sides, with the interval of 200 replicates of one side."""
    v = _side(_vectors(spark, d), "frechet", 2)
    return _rounded(lowrank.summary(lowrank.bootstrap_kernel(v.filter("side = 0"), v.filter("side = 1"), 200)))


@query(
    f"WITH {_FEATURES}, n AS (SELECT least(count(*) FILTER (side = 0), count(*) FILTER (side = 1), 100) AS m FROM s), r AS (SELECT unnest(range(1, 101)) AS subset), "
    f"x AS (SELECT subset, side, id, vec, row_number() OVER (PARTITION BY subset, side ORDER BY {_draw(chr(39) + 'subset' + chr(39), 'name', 'subset', 'id')}, id) AS k FROM (SELECT *, CASE WHEN side = 0 THEN 'a' ELSE 'b' END AS name FROM s), r), "
    "y AS (SELECT x.*, m FROM x, n WHERE k <= m), "
    f"p AS (SELECT u.subset, any_value(u.m) AS m, sum(CASE WHEN u.side = v.side THEN CASE WHEN u.id <> v.id THEN {_KERNEL.format('u.vec', 'v.vec')} / (u.m * (u.m - 1)) ELSE 0 END ELSE -{_KERNEL.format('u.vec', 'v.vec')} / (u.m * u.m) END) AS d FROM y u JOIN y v USING (subset) GROUP BY u.subset) "
    "SELECT count(*) AS subsets, any_value(m) AS size, round(avg(d), 6) AS distance, round(stddev_samp(d), 6) AS sd FROM p"
)
def kernel_subsets(spark, d):
    """The kernel distance as the mean over 100 subsets of up to 100 rows of either side, with its spread."""
    v = _side(_vectors(spark, d), "frechet", 2)
    each = lowrank.kernel_subsets(v.filter("side = 0"), v.filter("side = 1"), 100, 100)
    return _rounded(each.agg(F.count("*").alias("subsets"), F.max("size").alias("size"), F.avg("distance").alias("distance"), F.stddev_samp("distance").alias("sd")))


# SQL of two queries of the catalog that is made of the parts above.
ORACLES["frechet_distance"] = (
    ORACLES["frechet_bootstrap"].replace(_SUMMARY.format("f"), "SELECT round(distance, 6) AS distance FROM f")
    .replace("range(1, 201)", "range(1, 1)").replace("vec[1:16]", "vec").replace("range(16)", "range(64)").replace("range(1, 17)", "range(1, 65)")
)
ORACLES["pca_scores"] = (
    f"WITH RECURSIVE {_LONG}, mean AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM long GROUP BY pos)), "
    "z AS (SELECT id, unnest(range(64)) AS pos, unnest(list_transform(vec, lambda x, i: x - mean[i])) AS x FROM vec, mean), "
    "cov AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) / (count(*) - 1) AS c FROM z a JOIN z b USING (id) GROUP BY ALL), "
    f"c AS ({_MATRIX.format('cov')}), {_leading('c', 'one')}, {_DEFLATED}, {_leading('d', 'two')}, {_DEFLATED.replace('d AS', 'e AS').replace('c, one', 'd, two')}, {_leading('e', 'three')} "
    "SELECT id, " + ", ".join(f"round(list_dot_product(list_transform(vec, lambda x, i: x - mean[i]), {n}.v), 6) AS pc{k}" for k, n in ((1, "one"), (2, "two"), (3, "three"))) + " FROM vec, mean, one, two, three"
)
