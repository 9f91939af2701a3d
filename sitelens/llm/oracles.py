"""DuckDB SQL for the queries that SQL can express. It computes the results its own way: all windows,
all shingle pairs, all matches."""

from __future__ import annotations

from .op06_secrets import ASSIGN_WORDS

WORDS = r"[^\x20\x09-\x0D]+"

DE_BRUIJN = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM win),
own AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN own USING (s), (SELECT unnest(range(0, 13)) AS j) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
own AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
hit AS (SELECT doc_id, i FROM k JOIN own USING (s) WHERE m < doc_id),
mark AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM hit),
part AS (SELECT doc_id, i, sum((b IS NULL OR i > b + 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
gone AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM part GROUP BY doc_id, g),
edge AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM gone),
kept AS (SELECT e.doc_id, sum(z - a)::BIGINT AS n, count(*) AS spans, max(z) AS last,
    string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS t FROM edge e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t IS NULL THEN x ELSE t || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: kind, pattern, group whose length counts, least length
KINDS = [
    ("assign", rf"""((?i:{ASSIGN_WORDS}))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("hexup", "[0-9A-F]{24,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 20), ("userinfo", r"[a-z]{2,12}://([^\s/:@]+:[^\s/@]{3,})@", 1, 5)]


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS o, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS m, unnest(regexp_extract_all(t, '{p}', {g})) AS v, "
        f"unnest(string_split_regex(t, '{p}')[:-2]) AS g, unnest(range(0, len(regexp_extract_all(t, '{p}', 0)))) AS i, {least} AS least FROM d"
        for i, (kind, p, g, least) in enumerate(KINDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS z FROM f),
s AS (SELECT doc_id, kind, o, (z - length(m))::BIGINT AS a, kind || ':' || (z - length(m))::BIGINT || ':' || z::BIGINT AS x FROM p WHERE length(v) >= least),
r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(x, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(x, ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)"""


#: crc32 of the decimal id, bit by bit
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""

#: a run of 6 words and 4 periods has equal five words one period apart; stretches of them are the runs
PERIODIC = rf"""
WITH d AS (SELECT doc_id, {CRC} AS h, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS o FROM documents),
e AS (SELECT doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS made, h // 10 AS g, (h // 10) % greatest(len(o), 1) AS a FROM d),
f AS (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w FROM e),
k AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM f)),
c AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
j AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM c),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM j GROUP BY doc_id, q, g HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
  arg_min(struct_pack(a := start, b := length, c := period), struct_pack(x := -length::DOUBLE / period, y := start, z := period)) AS top FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS x FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM f) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.a::BIGINT AS start, top.b::BIGINT AS length, top.c::BIGINT AS period,
  (1000 * top.b // top.c)::BIGINT AS exponent_milli, sha256(coalesce(s, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM f LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)"""

RANKED = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, n GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN v USING (t), n GROUP BY item_id, doc_id HAVING score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""

SQL = {"op12_term_pipeline": RANKED, "op11_kruskal_runs": PERIODIC, "op4_de_bruijn": DE_BRUIJN, "op6_secret_ledger": _secrets(), "op9_merged_bwt": BYTES, "op10_minhash": NEAR}
