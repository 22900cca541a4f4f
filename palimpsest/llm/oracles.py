"""SQL twins, for DuckDB, of the queries that SQL can express: exact joins over whole tables.

The queries retrieve candidates by an index, and these compare all pairs, so they agree where the index misses nothing.
"""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"list_filter(regexp_split_to_array({LOWER}, '[ \\t-\\r]+'), lambda x: x <> '')"

#: every id with the ids that it reaches over links(a, b), which hold both directions
REACH = "reach AS (SELECT a AS id, b AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)"

VECTORS = f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM fine WHERE list_inner_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93
), {REACH},
least_ AS (SELECT id, min(r) AS m FROM reach GROUP BY id), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least_ l ON l.id = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w
), sh AS (SELECT doc_id, unnest(s) AS s FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS i FROM sh p JOIN sh q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN sizes m ON m.doc_id = x.a JOIN sizes n ON n.doc_id = x.b WHERE 100 * x.i >= 85 * (m.n + n.n - x.i)
), {REACH},
least_ AS (SELECT id, min(r) AS m FROM reach GROUP BY id)
SELECT z.doc_id, z.n::BIGINT AS n_shingles, least(z.doc_id, coalesce(l.m, z.doc_id)) AS component_id,
  z.doc_id = least(z.doc_id, coalesce(l.m, z.doc_id)) AS kept
FROM sizes z LEFT JOIN least_ l ON l.id = z.doc_id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS start FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, start, md5(array_to_string(w[start + 1:start + 50], ' ')) AS h FROM p),
marked AS (SELECT doc_id, start FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (
  SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run
  FROM (SELECT *, CASE WHEN start <= 50 + lag(start) OVER (PARTITION BY doc_id ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM marked)
), spans AS (SELECT doc_id, min(start) AS s, max(start) + 50 AS e FROM runs GROUP BY doc_id, run),
own AS (SELECT doc_id, sum(e - s) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM spans GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::INTEGER AS n_words, coalesce(own.n, 0)::INTEGER AS n_repeated, coalesce(own.spans, '') AS spans
FROM w LEFT JOIN own USING (doc_id)
"""


def _shingles(table: str, key: str) -> str:
    return f"""SELECT {key}, len(w) AS len, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS sh
      FROM (SELECT {key}, {WORDS} AS w FROM {table}) WHERE len(w) >= 5"""


LEAKS = f"""
WITH it AS ({_shingles("benchmark", "item_id")}), d AS ({_shingles("documents", "doc_id")}),
ip AS (SELECT item_id, len, unnest(sh) AS s, unnest(range(0, len(sh))) AS at FROM it),
idf AS (SELECT s, round(1000 * ln(1 + (SELECT count(*) FROM it) / count(DISTINCT item_id)))::BIGINT AS w FROM ip GROUP BY s),
ic AS (SELECT item_id, len, s, count(*) * any_value(idf.w) AS w FROM ip JOIN idf USING (s) GROUP BY item_id, len, s),
itot AS (SELECT item_id, sum(w) AS t FROM ic GROUP BY item_id),
dp AS (SELECT doc_id, unnest(sh) AS s, unnest(range(0, len(sh))) AS pos FROM d),
laid AS (SELECT DISTINCT dp.doc_id, greatest(dp.pos - ip.at, 0) AS start, ip.len FROM dp JOIN ip USING (s)),
win AS (SELECT laid.*, d.sh[start + 1:start + laid.len - 4] AS sh FROM laid JOIN d USING (doc_id)),
ws AS (SELECT doc_id, start, len, s, count(*) AS c FROM (SELECT doc_id, start, len, unnest(sh) AS s FROM win) GROUP BY doc_id, start, len, s),
wc AS (SELECT ws.* EXCLUDE (c), c * coalesce(idf.w, round(1000 * ln(1 + (SELECT count(*) FROM it)))::BIGINT) AS w FROM ws LEFT JOIN idf USING (s)),
wtot AS (SELECT doc_id, start, len, sum(w) AS t FROM wc GROUP BY doc_id, start, len),
sims AS (SELECT wc.doc_id, wc.start, wc.len, ic.item_id, sum(least(wc.w, ic.w)) AS m FROM wc JOIN ic ON ic.s = wc.s AND ic.len = wc.len GROUP BY ALL),
good AS (
  SELECT sims.*, round(m::DOUBLE / (wtot.t + itot.t - m), 6) AS sim FROM sims JOIN wtot USING (doc_id, start, len) JOIN itot USING (item_id)
  WHERE 1000 * m >= 800 * (wtot.t + itot.t - m)
)
SELECT doc_id, item_id, start::INTEGER AS start_word, len::INTEGER AS n_words, sim AS similarity
FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start, len DESC) = 1
"""

SQL = {"op2_near_embeddings": VECTORS, "op4_near_documents": NEAR, "op9_repeated_passages": REPEATS, "op10_benchmark_leaks": LEAKS}
