"""SQL of the longer oracles of this package's queries, for DuckDB."""

from __future__ import annotations

#: crc32 of the decimal id, bit by bit, before its last inversion.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, c: list_reduce(list_prepend(xor(r, c), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))"
PERIODIC_RUNS = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor({_CRC}, 4294967295) AS h FROM documents),
s AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
pl AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM s),
t0 AS (SELECT id, n, a, g, unnest(w) AS v, unnest(range(len(w))) AS i FROM pl),
src AS (SELECT id, i, CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END AS k FROM t0),
t AS MATERIALIZED (SELECT src.id, src.i, t0.v FROM src JOIN t0 ON src.id = t0.id AND src.k = t0.i),
pd AS (SELECT id, n, unnest(range(1, n // 4 + 1)) AS p FROM pl),
gr AS (SELECT id, p, unnest(range(0, (n - 1) // p - 2)) * p AS i FROM pd),
e0 AS MATERIALIZED (SELECT gr.id, gr.p, gr.i, v FROM gr JOIN t ON gr.id = t.id AND gr.i = t.i),
e1 AS MATERIALIZED (SELECT e0.* FROM e0 JOIN t ON e0.id = t.id AND e0.i + e0.p = t.i AND e0.v = t.v),
e2 AS MATERIALIZED (SELECT e1.* FROM e1 JOIN t ON e1.id = t.id AND e1.i + 2 * e1.p = t.i AND e1.v = t.v),
e3 AS MATERIALIZED (SELECT DISTINCT e2.id, e2.p FROM e2 JOIN t ON e2.id = t.id AND e2.i + 3 * e2.p = t.i AND e2.v = t.v),
e4 AS MATERIALIZED (SELECT e3.id, e3.p, t.i, t.v FROM e3 JOIN t ON e3.id = t.id),
eq AS (SELECT e4.id, e4.p, e4.i FROM e4 JOIN t ON e4.id = t.id AND e4.i + e4.p = t.i AND e4.v = t.v),
isl AS (SELECT id, p, i, i - row_number() OVER (PARTITION BY id, p ORDER BY i) AS k FROM eq),
st AS (SELECT id, p, min(i) AS s, count(*) + p AS l FROM isl GROUP BY id, p, k HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT id, s, l, min(p) AS p FROM st GROUP BY id, s, l),
told AS (SELECT id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS runs FROM r GROUP BY id),
best AS (SELECT id, s, l, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l DESC, s, p) AS k FROM r) WHERE k = 1),
gone AS (SELECT DISTINCT id, unnest(range(s + p, s + l)) AS i FROM r),
kept AS (SELECT t.id, string_agg(v, ' ' ORDER BY t.i) AS words FROM t LEFT JOIN gone ON t.id = gone.id AND t.i = gone.i WHERE gone.i IS NULL GROUP BY t.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, p AS period, 1000 * l // p AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM pl LEFT JOIN told ON pl.id = told.id LEFT JOIN best ON pl.id = best.id LEFT JOIN kept ON pl.id = kept.id
"""
FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > low THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM o)),
j AS (SELECT part, filter_order, step, n, good, toxic, mask = bit AS alone, mask & bit <> 0 AS fails, mask & before <> 0 AS gone, 120 // greatest(1, bit_count(mask)) AS share FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * share) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
REPEATS = """
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, id, x, length(x) // 2 AS n FROM d),
w AS (SELECT id, unnest(range(0, n - 99)) AS i FROM n),
s AS (SELECT w.id, w.i, sha256(substr(n.x, 2 * w.i + 1, 200)) AS s FROM w JOIN n ON w.id = n.id),
a AS (SELECT id, i FROM (SELECT id, i, row_number() OVER (PARTITION BY s ORDER BY id, i) AS k FROM s) WHERE k > 1),
g AS (SELECT id, i, i - row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM a),
b AS (SELECT id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY id, k),
c AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
m AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY s) AS k FROM c),
r AS (SELECT id, min(s) AS s, max(e) AS e FROM m GROUP BY id, k),
q AS (SELECT id, s, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS f, e FROM r),
o AS (SELECT q.id, count(*) AS n_spans, sum(q.e - q.s) AS n_removed, string_agg(substr(n.x, 2 * q.f + 1, 2 * (q.s - q.f)), '' ORDER BY q.s) AS head, max(q.e) AS last FROM q JOIN n ON q.id = n.id GROUP BY q.id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN o ON n.id = o.id
"""
