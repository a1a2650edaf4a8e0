"""The queries of this subpackage as SQL for DuckDB, where SQL can express them.

Without SQL: op1 and op2 (models fitted to the corpus), op3 (windows of bytes are too many for SQL
over whole tables), op6 and op9 (trained models) and op10 (a tokenizer). Tests hold those against
brute force, round trips or held-out accuracy.
"""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
m AS (SELECT a, min(root) AS root FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT p, min(doc_id) AS least FROM v GROUP BY p),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM v JOIN f USING (p) WHERE doc_id > least),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM a ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

_MARKS = (
    r"len(regexp_extract_all({0}, '\\[blsn]')) + len(regexp_extract_all({0}, '<(?:\|turn\|>|\|end\|>|/?s>)')) + len(regexp_extract_all({0}, '\[/?INST\]'))"
)
_OP7 = f"""
WITH c AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, 17 + length(role) + length(text) + len(regexp_extract_all(role, '\\n')) + {_MARKS.format('role')} + {_MARKS.format('text')} AS size FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::bigint AS formatted_chars
FROM f GROUP BY conv_id
"""

_OP8 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM benchmark),
iw AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, n, i, item_id FROM dw JOIN iw USING (n, p)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM m) GROUP BY doc_id),
pw AS (SELECT p, n, string_split(p, ' ') AS w FROM (SELECT DISTINCT p, n FROM iw)),
pt AS (SELECT p, o, CASE WHEN n = 1 THEN w[1] ELSE w[o + 1] || ' ' || w[o + 2] END AS t FROM (SELECT p, n, w, unnest(range(greatest(n - 1, 1))) AS o FROM pw)),
dt AS (SELECT doc_id, pos, t FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS t FROM d UNION ALL
  SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1)) WHERE t IN (SELECT t FROM pt)),
df AS (SELECT t, count(*) AS df FROM dt GROUP BY t),
rk AS (SELECT p, o, t, row_number() OVER (PARTITION BY p ORDER BY coalesce(df, 0), o) AS r, min(coalesce(df, 0)) OVER (PARTITION BY p) AS least FROM pt LEFT JOIN df USING (t)),
q AS (SELECT p, o, t, count(*) OVER (PARTITION BY p) AS needed, min(o) OVER (PARTITION BY p) AS lead FROM rk WHERE r <= 3 AND least > 0),
ap AS (SELECT doc_id, p, o, needed, lead, pos - o AS st FROM dt JOIN q USING (t)),
nr AS (SELECT a.doc_id, a.p FROM ap a JOIN ap b ON a.doc_id = b.doc_id AND a.p = b.p AND abs(a.st - b.st) <= 3 WHERE a.o = a.lead GROUP BY a.doc_id, a.p, a.st HAVING count(DISTINCT b.o) = max(b.needed)),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN iw USING (p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

_CRC = """list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT))"""
_OP11 = f"""
WITH tab AS (SELECT {_CRC} AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM})) AS w FROM benchmark),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bucket AS (SELECT w, xor(list_reduce(x, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM bytes, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b), n),
weight AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN weight USING (doc_id)),
score AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS i, count(*) OVER () AS n FROM score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, i AS rank FROM score LEFT JOIN (SELECT doc_id, i FROM able WHERE i <= 10 * n // 100) USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op4_minhash_dedup": _OP4,
    "op5_substring_dedup": _OP5,
    "op7_chat_format": _OP7,
    "op8_decontaminate": _OP8,
    "op11_importance_resampling": _OP11,
}
