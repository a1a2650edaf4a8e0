"""The catalog's queries as SQL for DuckDB on the same tables. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from .catalog import N_BOOT, N_PERM


def _draw(*parts: str) -> str:
    text = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint)"


_CELLS = "cells AS (SELECT event_type, user_id, avg(value) AS value FROM events GROUP BY ALL)"
_DAILY = "daily AS (SELECT event_type, day(ts)::int AS step, avg(value) AS v FROM events GROUP BY ALL)"
_PAIRS = f"{_CELLS}, deltas AS (SELECT a.user_id, a.value - b.value AS delta FROM cells a JOIN cells b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type = 'view')"
_VEC = "vec AS (SELECT vec_id AS id, embedding::double[] AS vec, label AS grp FROM embeddings)"
_LONG = f"{_VEC}, long AS (SELECT id, grp, unnest(range(64))::int AS pos, unnest(vec) AS x FROM vec)"


def _boot(source: str, group: str, order: str, stat: str) -> str:
    """CTEs placed, drawn, reps: replicates of a statistic over rows drawn with replacement."""
    part = f"PARTITION BY {group}" if group else ""
    g = f"{group}, " if group else ""
    using = f"({g}i)"
    return (
        f"placed AS (SELECT *, row_number() OVER ({part} ORDER BY {order}) - 1 AS i, count(*) OVER ({part}) AS n FROM {source}), "
        f"sizes AS (SELECT {g}max(n) AS n FROM placed {'GROUP BY ' + group if group else ''}), "
        f"h0 AS (SELECT {g}n, rep, (seed + rep * 2654435769 + k * 2246822519) & 4294967295 AS h FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT {g}n, {_draw(chr(39) + 'boot' + chr(39), *filter(None, [group]))} AS seed, unnest(range(1, {N_BOOT} + 1)) AS rep FROM sizes))), "
        f"h1 AS (SELECT {g}n, rep, (xor(h, h >> 16) * 2146121005) & 4294967295 AS h FROM h0), h2 AS (SELECT {g}n, rep, (xor(h, h >> 15) * 1812433253) & 4294967295 AS h FROM h1), "
        f"drawn AS (SELECT {g}rep, xor(h, h >> 16) % n AS i FROM h2), "
        f"reps AS (SELECT {g}rep, {stat} AS stat FROM drawn JOIN placed USING {using} GROUP BY ALL)"
    )


_CI = "quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi"
_NATION = "m AS (SELECT c_nationkey AS id, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
_EFFECTS = (
    "mm AS (SELECT l_returnflag, l_linestatus, month(l_shipdate) AS month, avg(l_discount) AS m FROM lineitem GROUP BY ALL), "
    "eff AS (SELECT mm.l_returnflag, l_linestatus, month, mm.m - b.m AS delta FROM mm JOIN (SELECT * FROM mm WHERE l_returnflag = 'A') b USING (l_linestatus, month) WHERE mm.l_returnflag <> 'A')"
)
_SPLIT = (
    f"es AS (SELECT c_custkey, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + 5 THEN 'seed' ELSE 'ref' END AS split FROM "
    f"(SELECT c_custkey, row_number() OVER (ORDER BY {_draw(chr(39) + 'split' + chr(39), 'c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer))"
)
_BASIS = (
    "grid AS (SELECT unnest(range(8)) AS u), "
    "basis AS (SELECT (a.u * 8 + b.u)::int AS pos, i.u::int AS i, j.u::int AS j, "
    "(CASE WHEN i.u = 0 THEN sqrt(1/8.0) ELSE sqrt(2/8.0) END) * cos(pi() * (2 * a.u + 1) * i.u / 16) * (CASE WHEN j.u = 0 THEN sqrt(1/8.0) ELSE sqrt(2/8.0) END) * cos(pi() * (2 * b.u + 1) * j.u / 16) AS b "
    "FROM grid a, grid b, grid i, grid j)"
)


def _power(where: str = "true", name: str = "power") -> str:
    return f"{name} AS (SELECT i, j, CASE WHEN i = 0 AND j = 0 THEN 0.0 ELSE var_pop(c) END AS power FROM (SELECT id, i, j, sum(x * b) AS c FROM long JOIN basis USING (pos) WHERE {where} GROUP BY ALL) GROUP BY i, j)"


_OCT = "bins AS (SELECT b::int AS bin, 0.5 * 2.0 ** b AS lo, 0.5 * 2.0 ** (b + 1) AS hi, b = 3 AS is_last FROM (SELECT unnest(range(4)) AS b))"
_IN = "sqrt(i * i + j * j) / 2 >= lo AND (sqrt(i * i + j * j) / 2 < hi OR (is_last AND sqrt(i * i + j * j) / 2 = hi))"


def _profile(power: str, name: str) -> str:
    return f"{name} AS (SELECT bin, count(*) AS n_modes, avg(power) AS mean_power FROM {power} JOIN bins ON {_IN} WHERE i + j > 0 GROUP BY bin)"


_UNIT = f"{_VEC}, vc AS (SELECT * FROM vec UNION ALL SELECT id + 100000, list_transform(vec, lambda x, i: CASE WHEN i = 8 THEN x + 0.05 ELSE x END), grp FROM vec WHERE id % 25 = 0), c AS (SELECT id, grp, list_transform(vec, lambda x: x - list_avg(vec)) AS v FROM vc), u AS (SELECT id, grp, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM c)"
_NEAR = f"{_UNIT}, near AS (SELECT a.id AS a, b.id AS b, list_inner_product(a.u, b.u) AS r FROM u a JOIN u b ON a.id < b.id WHERE list_inner_product(a.u, b.u) > 0.9)"


def _nn(q: str, c: str, k: int, extra: str = "") -> str:
    return f"(SELECT * FROM (SELECT q_id, c_id, dist, row_number() OVER (PARTITION BY q_id ORDER BY dist, c_id) AS rank FROM (SELECT a.id AS q_id, b.id AS c_id, list_distance(a.vec, b.vec) AS dist FROM {q} a JOIN {c} b ON a.id <> b.id {extra})) WHERE rank <= {k})"


def _side(salt: str, n: int) -> str:
    return f"{_VEC}, s AS (SELECT *, {_draw(chr(39) + salt + chr(39), 'id')} % {n} AS side FROM vec)"


_K = "CAST(props->>'$.k' AS int)"

ORACLES: dict[str, str] = {
    "paired_contrast": f"WITH {_PAIRS}, {_boot('deltas', '', 'user_id', 'avg(delta)')}, ci AS (SELECT {_CI} FROM reps), p AS (SELECT count(*) AS n, avg(delta) AS d FROM deltas) SELECT n, round(d, 6) AS mean_delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS excludes_zero FROM p, ci",
    "contrast_table": f"WITH {_CELLS}, deltas AS (SELECT a.event_type, a.user_id, a.value - b.value AS delta FROM cells a JOIN cells b USING (user_id) WHERE a.event_type <> 'view' AND b.event_type = 'view'), {_boot('deltas', 'event_type', 'user_id', 'avg(delta)')}, ci AS (SELECT event_type, {_CI} FROM reps GROUP BY ALL), p AS (SELECT event_type, count(*) AS n, avg(delta) AS d FROM deltas GROUP BY ALL) SELECT event_type, n, round(d, 6) AS mean_delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, lo > 0 OR hi < 0 AS excludes_zero, CASE WHEN n < 100 THEN 'incomplete: ' || n || '/100' WHEN NOT (lo > 0 OR hi < 0) THEN 'not detectable' ELSE 'ok' END AS status FROM p JOIN ci USING (event_type)",
    "interaction": f"WITH {_PAIRS}, h AS (SELECT *, {_draw(chr(39) + 'half' + chr(39), 'user_id')} % 2 AS half FROM deltas), {_boot('h', 'half', 'user_id', 'avg(delta)')}, two AS (SELECT rep, max(stat) FILTER (half = 0) - max(stat) FILTER (half = 1) AS stat FROM reps GROUP BY rep), ci AS (SELECT {_CI} FROM two), p AS (SELECT count(*) AS n, avg(delta) FILTER (half = 0) - avg(delta) FILTER (half = 1) AS d FROM h) SELECT n, round(d, 6) AS difference, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM p, ci",
    "permutation_exact": "WITH p AS (SELECT n_regionkey AS id, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), t AS (SELECT sum(value) AS total, count(*) AS n, avg(value) FILTER (id < 2) - avg(value) FILTER (id >= 2) AS obs FROM p), w AS (SELECT (a.value + b.value) / 2 - (total - a.value - b.value) / (n - 2) AS stat, obs FROM p a JOIN p b ON a.id < b.id, t) SELECT round(obs, 6) AS observed, count(*) AS n_assignments, round(avg((abs(stat) >= abs(obs) - 1e-9 * greatest(1, abs(obs)))::int), 6) AS p_value, round(2 / count(*), 6) AS p_min FROM w GROUP BY obs",
    "permutation_sampled": f"WITH {_NATION}, t AS (SELECT count(*) FILTER (id < 12) AS na, avg(value) FILTER (id < 12) - avg(value) FILTER (id >= 12) AS obs FROM m), d AS (SELECT rep, value, row_number() OVER (PARTITION BY rep ORDER BY {_draw(chr(39) + 'perm' + chr(39), 'rep', 'id', 'side')}, id) AS r FROM (SELECT *, CASE WHEN id < 12 THEN 'a' ELSE 'b' END AS side FROM m), (SELECT unnest(range(1, {N_PERM} + 1)) AS rep)), s AS (SELECT rep, obs, avg(value) FILTER (r <= na) - avg(value) FILTER (r > na) AS stat FROM d, t GROUP BY rep, obs) SELECT round(obs, 6) AS observed, count(*) AS n_assignments, round((1 + count(*) FILTER (abs(stat) >= abs(obs) - 1e-9 * greatest(1, abs(obs)))) / (1 + count(*)), 6) AS p_value, round(1 / (1 + count(*)), 6) AS p_min FROM s GROUP BY obs",
    "cluster_bootstrap": f"WITH li AS (SELECT l_suppkey, sum(l_discount) AS s, count(*) AS k FROM lineitem GROUP BY ALL), {_boot('li', '', 'l_suppkey', 'sum(s) / sum(k)')}, ci AS (SELECT {_CI} FROM reps) SELECT (SELECT count(*) FROM li) AS clusters, round((SELECT sum(s) / sum(k) FROM li), 6) AS ratio, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM ci",
    "decomposition": f"WITH {_EFFECTS}, p AS (SELECT l_returnflag || '/' || l_linestatus AS part, month AS unit, delta FROM eff), ok AS (SELECT unit FROM p GROUP BY unit HAVING count(DISTINCT part) = (SELECT count(DISTINCT part) FROM p)), g AS (SELECT part, count(*) AS n, avg(delta) AS delta FROM p JOIN ok USING (unit) GROUP BY part) SELECT part, n, round(delta, 8) AS delta, round(delta / sum(delta) OVER (), 4) AS share FROM g",
    "transfer_sign": f"WITH {_EFFECTS}, e AS (SELECT l_linestatus, l_returnflag || '/' || month AS endpoint, avg(delta) AS v FROM eff GROUP BY ALL) SELECT a.l_linestatus AS group_a, b.l_linestatus AS group_b, count(*) AS n, round(avg((sign(a.v) = sign(b.v))::int), 6) AS agree FROM e a JOIN e b USING (endpoint) WHERE a.l_linestatus < b.l_linestatus GROUP BY ALL",
    "design_join_status": "WITH d AS (SELECT n_name, c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)), o AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) >= 5) SELECT n_name, c_mktsegment, coalesce(n, 0) AS n, n IS NOT NULL AS present, CASE WHEN count(n) OVER w = count(*) OVER w THEN 'complete' ELSE 'incomplete: ' || count(n) OVER w || '/' || count(*) OVER w END AS status FROM d LEFT JOIN o USING (n_name, c_mktsegment) WINDOW w AS (PARTITION BY n_name)",
    "first_crossing": f"WITH {_DAILY}, t AS (SELECT arg_max(v, step) AS thr FROM daily WHERE event_type = 'view') SELECT event_type, min(step) FILTER (v <= thr) AS first_step FROM daily, t GROUP BY event_type",
    "settling_step": f"WITH {_DAILY}, t AS (SELECT event_type, quantile_cont(v, 0.9) AS thr FROM daily GROUP BY ALL), a AS (SELECT event_type, max(step) FILTER (v > thr) AS la FROM daily JOIN t USING (event_type) GROUP BY ALL) SELECT event_type, min(step) FILTER (la IS NULL OR step > la) AS settle_step FROM daily JOIN a USING (event_type) GROUP BY event_type",
    "plateau_step": f"WITH {_DAILY}, e AS (SELECT event_type, max(step) AS fin FROM daily GROUP BY ALL), f AS (SELECT event_type, fin, avg(v) FILTER (step > fin - 5) AS fm FROM daily JOIN e USING (event_type) GROUP BY ALL), o AS (SELECT event_type, fin, fm, max(step) FILTER (abs(v - fm) > 3.0) AS off FROM daily JOIN f USING (event_type) GROUP BY ALL) SELECT event_type, coalesce(min(step) FILTER (off IS NULL OR step > off), max(fin)) AS plateau, round(max(fm), 6) AS final_mean FROM daily JOIN o USING (event_type) GROUP BY event_type",
    "running_mean": f"WITH {_DAILY}, s AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY step ROWS 4 PRECEDING) AS m, count(*) OVER (PARTITION BY event_type) AS n FROM daily) SELECT event_type, step, round(v, 6) AS v, round(m, 6) AS smooth, round(CASE WHEN n < 5 THEN v ELSE m END, 6) AS smooth_or_raw FROM s",
    "curve_summary": f"WITH {_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, step) AS k FROM daily) SELECT event_type, round(arg_min(v, step), 6) AS first_v, max(step) FILTER (k = 1) AS peak_step, round(max(v), 6) AS peak_v, round(arg_max(v, step), 6) AS last_v FROM r GROUP BY event_type",
    "schedule_check": f"WITH {_DAILY}, l AS (SELECT event_type, v - lag(v) OVER (PARTITION BY event_type ORDER BY step) AS d FROM daily) SELECT event_type, count(*) AS n, count(*) FILTER (d <= 0) AS n_falls FROM l GROUP BY event_type",
    "components_for_share": "WITH o AS (SELECT o_orderpriority, o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority, row_number() OVER w AS k, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY o_orderpriority) AS part FROM o WINDOW w AS (PARTITION BY o_orderpriority ORDER BY v DESC, o_custkey)) SELECT o_orderpriority, min(k) AS k FROM r WHERE part >= 0.5 - 1e-12 GROUP BY ALL",
    "within_group_corr": "WITH m AS (SELECT *, l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) AS q, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) AS p FROM lineitem) SELECT round(corr(q, p), 6) AS within, round(corr(l_quantity, l_extendedprice), 6) AS overall FROM m",
    "loglog_slope": "WITH f AS (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey), g AS (SELECT n, count(*) AS parts FROM f GROUP BY n), r AS (SELECT n, sum(parts) OVER (ORDER BY n DESC) AS rank FROM g) SELECT count(*) AS points, round(-regr_slope(ln(n), ln(rank)), 6) AS alpha FROM r",
    "entity_split": f"WITH {_SPLIT} SELECT * FROM es",
    "stratified_split": f"WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), e AS (SELECT *, n * 101 / (sum(n) OVER ()) AS x FROM s), b AS (SELECT *, floor(x) AS low, row_number() OVER (ORDER BY x - floor(x) DESC, c_mktsegment) AS r FROM e), q AS (SELECT c_mktsegment, low + (r <= 101 - (sum(low) OVER ()))::int AS quota FROM b), k AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_draw(chr(39) + 'strata' + chr(39), 'c_custkey')}, c_custkey) AS r FROM customer) SELECT c_mktsegment, CASE WHEN r <= quota THEN 'chosen' ELSE 'rest' END AS split, count(*) AS n, sum(c_custkey)::bigint AS key_sum FROM k JOIN q USING (c_mktsegment) GROUP BY ALL",
    "leakage_check": f"WITH {_SPLIT}, p AS (SELECT o_custkey, count(DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN 'moved' ELSE split END) AS k FROM orders LEFT JOIN es ON o_custkey = c_custkey GROUP BY ALL) SELECT count(*) AS entities, count(*) FILTER (k > 1) AS leaks FROM p",
    "partition_check": f"WITH {_SPLIT} SELECT count(*) AS n, count(*) FILTER (split IS NULL) AS unassigned, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'seed') AS n_seed FROM orders LEFT JOIN es ON o_custkey = c_custkey",
    "mad_gate": "WITH m AS (SELECT median(s_acctbal) AS med FROM supplier), d AS (SELECT median(abs(s_acctbal - med)) AS mad FROM supplier, m) SELECT s_suppkey, round(s_acctbal, 6) AS s_acctbal, round(med, 6) AS med, round(mad, 6) AS mad, s_acctbal > med + 3 * mad AS outlier_raw, s_acctbal > med + 3 * 1.4826 * mad AS outlier_scaled FROM supplier, m, d",
    "exact_dedup": "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_idx, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS kept FROM documents",
    "rejection_counts": "WITH r AS (SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars > 10000 THEN 'long' ELSE 'ok' END AS reason FROM documents) SELECT source, reason, count(*) AS n, (sum(count(*)) OVER (PARTITION BY source))::bigint AS scanned FROM r GROUP BY source, reason",
    "accept_first_n": "SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars >= 200 GROUP BY sha256(text) ORDER BY 1 LIMIT 100",
    "knn": f"WITH {_VEC}, q AS (SELECT * FROM vec WHERE id % 100 = 0) SELECT q_id, c_id, round(dist, 6) AS dist, rank FROM {_nn('q', 'vec', 5)}",
    "knn_other_group": f"WITH {_VEC}, q AS (SELECT * FROM vec WHERE id % 100 = 0) SELECT q_id, c_id, round(dist, 6) AS dist, rank FROM {_nn('q', 'vec', 1, 'AND a.grp <> b.grp')}",
    "near_dup_pairs": f"WITH {_NEAR} SELECT a, b, round(r, 6) AS r FROM near",
    "near_dup_screen": f"WITH {_NEAR} SELECT grp, count(*) AS n, count(*) FILTER (id IN (SELECT b FROM near)) AS n_near FROM vc GROUP BY grp",
    "memorisation_ratio": f"WITH {_side('mem', 3)}, tr AS (SELECT * FROM s WHERE side = 0), h AS (SELECT * FROM s WHERE side = 1), g AS (SELECT * FROM s WHERE side = 2), x AS (SELECT (SELECT median(dist) FROM {_nn('h', 'tr', 1)}) AS held, (SELECT median(dist) FROM {_nn('g', 'tr', 1)}) AS sample) SELECT round(held, 6) AS held, round(sample, 6) AS sample, round(sample / held, 6) AS ratio FROM x",
    "prdc": f"WITH {_side('prdc', 2)}, a AS (SELECT * FROM s WHERE side = 0), b AS (SELECT * FROM s WHERE side = 1), ra AS (SELECT q_id, dist AS rad FROM {_nn('a', 'a', 5)} WHERE rank = 5), rb AS (SELECT q_id, dist AS rad FROM {_nn('b', 'b', 5)} WHERE rank = 5), fr AS (SELECT b.id AS p, a.id AS c FROM b, a JOIN ra ON a.id = ra.q_id WHERE list_distance(a.vec, b.vec) < rad), rf AS (SELECT a.id AS p FROM a, b JOIN rb ON b.id = rb.q_id WHERE list_distance(a.vec, b.vec) < rad), nn AS (SELECT (SELECT count(*) FROM a) AS nr, (SELECT count(*) FROM b) AS nf) SELECT round((SELECT count(DISTINCT p) FROM fr) / nf, 6) AS precision, round((SELECT count(DISTINCT p) FROM rf) / nr, 6) AS recall, round((SELECT count(*) FROM fr) / (5 * nf), 6) AS density, round((SELECT count(DISTINCT c) FROM fr) / nr, 6) AS coverage FROM nn",
    "intrinsic_dim": f"WITH {_VEC}, n AS {_nn('vec', 'vec', 10)}, t AS (SELECT *, max(dist) OVER (PARTITION BY q_id) AS t FROM n), e AS (SELECT q_id, sum(ln(t / dist)) / 9 AS m FROM t WHERE rank < 10 AND dist > 0 GROUP BY q_id) SELECT count(*) AS n, round(1 / avg(m), 6) AS dim, 'ok' AS status FROM e",
    "participation_ratio": f"WITH {_LONG}, c AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM long a JOIN long b USING (id) GROUP BY ALL) SELECT round(sum(c) FILTER (i = j), 6) AS trace, round((sum(c) FILTER (i = j)) ** 2 / sum(c * c), 6) AS ratio FROM c",
    "group_diversity": f"WITH {_LONG}, p AS (SELECT grp, pos, var_pop(x) AS v, count(*) AS n FROM long GROUP BY ALL) SELECT grp, max(n) AS n, round(sum(v) / (count(*) - 1), 6) AS diversity FROM p GROUP BY grp",
    "mode_power": f"WITH {_LONG}, {_BASIS}, {_power()} SELECT i, j, round(power, 6) AS power FROM power",
    "octave_shares": f"WITH {_LONG}, {_BASIS}, {_power()}, {_OCT}, s AS (SELECT bin, sum(power) AS p FROM power JOIN bins ON {_IN} WHERE i + j > 0 GROUP BY bin) SELECT bin, round(coalesce(p, 0) / (SELECT sum(p) FROM s), 6) AS share FROM bins LEFT JOIN s USING (bin)",
    "radial_profile": f"WITH {_LONG}, {_BASIS}, {_power()}, {_OCT}, {_profile('power', 'pr')} SELECT bin, n_modes, round(mean_power, 6) AS mean_power FROM pr",
    "log_spectral_distance": f"WITH {_LONG}, {_BASIS}, {_power('grp = 0', 'pa')}, {_power('grp <> 0', 'pb')}, {_OCT}, {_profile('pa', 'a')}, {_profile('pb', 'b')}, d AS (SELECT log10(a.mean_power) - log10(b.mean_power) AS d FROM a JOIN b USING (bin) WHERE a.mean_power > 0 AND b.mean_power > 0) SELECT count(*) AS n_bins, round(sqrt(avg(d * d)), 6) AS lsd FROM d",
    "low_pass_share": f"WITH {_LONG}, {_BASIS}, {_power()} SELECT round(sum(power * exp(-(pi() ** 2) * (i * i + j * j) / 64)) / sum(power), 6) AS share FROM power",
    "histogram": "WITH c AS (SELECT l_quantity::int AS v, count(*) AS n FROM lineitem GROUP BY ALL), f AS (SELECT g::int AS v, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 61)) AS g) LEFT JOIN c ON c.v = g) SELECT v, n, round(n / sum(n) OVER (), 6) AS share FROM f",
    "bin_counts": "WITH b AS (SELECT k::int AS bin, 100 * 2.0 ** k AS lo, 100 * 2.0 ** (k + 1) AS hi, k = 6 AS l FROM (SELECT unnest(range(7)) AS k)) SELECT bin, count(*) AS n FROM lineitem JOIN b ON l_extendedprice >= lo AND (l_extendedprice < hi OR (l AND l_extendedprice = hi)) GROUP BY bin",
    "majority_drift": "WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY k DESC, l_returnflag) AS r FROM c) SELECT l_suppkey, max(l_returnflag) FILTER (r = 1) AS modal, sum(k)::bigint AS n, coalesce(sum(k) FILTER (r > 1), 0)::bigint AS n_drift FROM r GROUP BY ALL",
    "step_windows": "SELECT ceil(event_id / 50)::bigint AS \"window\", count(*) AS n, count(*) FILTER (event_type = 'error') AS n_error, round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_value FROM events GROUP BY ALL",
    "rewind_canonical": f"WITH e AS (SELECT *, {_K} AS step FROM events), k AS (SELECT *, min(CASE WHEN event_type = 'error' THEN step END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM e) SELECT user_id, count(*) AS n_kept, count(*) FILTER (event_type = 'error') AS n_resumes, sum(event_id)::bigint AS id_sum FROM k WHERE back IS NULL OR coalesce(step, -1) < back GROUP BY user_id",
    "failure_streaks": "WITH m AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS isl FROM events), r AS (SELECT user_id, bad, isl, count(*) AS k FROM m GROUP BY ALL) SELECT user_id, coalesce(sum(k) FILTER (bad), 0)::bigint AS n_failed, coalesce(max(k) FILTER (bad), 0) AS longest FROM r GROUP BY user_id",
    "cadence_check": "WITH h AS (SELECT DISTINCT conv_id, turn::bigint AS s FROM conversations WHERE (conv_id * 7 + turn) % 11 <> 0), w AS (SELECT conv_id, unnest(range(max(s) + 1)) AS s FROM h GROUP BY conv_id) SELECT conv_id, count(*) FILTER (h.s IS NULL) AS n_missing, count(*) FILTER (w.s IS NULL) AS n_extra FROM h FULL JOIN w USING (conv_id, s) GROUP BY conv_id",
    "terminal_event": "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY ALL",
    "json_flatten": f"SELECT event_id, {_K} AS k FROM events",
    "schema_rules": "WITH e AS (SELECT event_type, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN true ELSE json_keys(props) <> ['k'] END AS bad, CASE WHEN event_id % 13 = 0 THEN -1.0 ELSE value END AS value FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (bad) AS bad_keys, count(*) FILTER (value IS NULL OR isnan(value) OR value < 0) AS bad_values FROM e GROUP BY ALL",
    "reconcile_sources": "WITH l AS (SELECT l_suppkey, l_returnflag AS metric, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), o AS (SELECT l_suppkey, metric, CASE WHEN metric = 'N' AND l_suppkey % 3 = 0 THEN w * 1.001 ELSE w END AS v FROM l WHERE NOT (metric = 'A' AND l_suppkey % 4 = 0)), g AS (SELECT l_suppkey, metric FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(['A', 'N', 'R']) AS metric)) SELECT metric, count(*) AS n, count(*) FILTER (w IS NULL OR v IS NULL) AS n_missing, count(*) FILTER (abs(w - v) > 1e-9 * greatest(abs(w), abs(v))) AS n_differ FROM g LEFT JOIN l USING (l_suppkey, metric) LEFT JOIN o USING (l_suppkey, metric) GROUP BY metric",
    "wide_index": f"WITH {_CELLS} SELECT user_id, " + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM cells GROUP BY user_id",
    "grouped_summary": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(min(o_totalprice), 6) AS lo, round(max(o_totalprice), 6) AS hi, round(median(o_totalprice), 6) AS med, round(stddev_samp(o_totalprice), 6) AS sd, round(stddev_pop(o_totalprice), 6) AS sd_pop, count(DISTINCT o_custkey) AS customers, bool_and(o_totalprice > 0) AS all_positive FROM orders GROUP BY ALL",
    "multiplicity": "WITH k AS (SELECT count(*) AS k FROM orders GROUP BY o_custkey) SELECT sum(k)::bigint AS n, count(*) AS distinct_keys, max(k) AS most, count(*) FILTER (k > 1) AS repeated FROM k",
    "config_diff": "WITH c AS (SELECT c_nationkey AS key, count(*) AS a FROM customer GROUP BY ALL), s AS (SELECT s_nationkey AS key, count(*) AS b FROM supplier GROUP BY ALL) SELECT key, a, b FROM c FULL JOIN s USING (key) WHERE a IS DISTINCT FROM b",
    "held_out_anti": "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::bigint AS key_sum FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) GROUP BY ALL",
    "contamination": "WITH x AS (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark WHERE item_id % 3 = 0) SELECT count(*) AS n, min(doc_id) AS first_id FROM x WHERE sha256(text) IN (SELECT sha256(text) FROM benchmark)",
    "union_conflicts": "WITH k AS (SELECT count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS keys, count(*) FILTER (k > 1) AS conflicts FROM k",
    "batches": f"WITH r AS (SELECT o_orderkey, year(o_orderdate)::int AS y, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY {_draw(chr(39) + 'shuffle' + chr(39), 'o_orderkey')}, o_orderkey) AS r FROM orders) SELECT y, ceil(r / 64)::bigint AS batch, count(*) AS n, min(o_orderkey) AS least FROM r GROUP BY ALL HAVING count(*) = 64",
    "kernel_distance": f"WITH {_side('frechet', 2)}, k AS (SELECT a.side AS p, b.side AS q, (list_inner_product(a.vec, b.vec) / 64 + 1) ** 3 AS k FROM s a JOIN s b ON a.id <> b.id), t AS (SELECT p, q, avg(k) AS m FROM k GROUP BY ALL) SELECT (SELECT count(*) FROM s WHERE side = 0) AS n_a, (SELECT count(*) FROM s WHERE side = 1) AS n_b, round(sum(CASE WHEN p = q THEN m ELSE -m END), 6) AS distance FROM t",
}
