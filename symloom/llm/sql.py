"""SQL of operators whose results plain SQL can recompute; DuckDB runs it over the same tables."""

# Word triples of ASCII-lower-cased texts, pairs by common triples, components by reachability.
OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * p.k >= 90 * (i.k + j.k - p.k)),
links AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT r.a, t.y FROM reach r JOIN links t ON t.x = r.b)
SELECT w.doc_id, coalesce(n.k, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id
"""

# All windows of 400 bytes by their MD5, runs of repeated ones, and what is left of the texts; windows of 50 words likewise.
OP8 = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(h[i + 1:i + 400]) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS i FROM d) x),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM w WHERE k IN (SELECT k FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c) y GROUP BY doc_id, g),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS f, a AS t FROM e),
j AS (SELECT k.doc_id, string_agg(hex(h[f + 1:t]), '' ORDER BY f) AS h FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
v AS (SELECT doc_id, md5_number(array_to_string(l[i + 1:i + 50], ' ')) AS k FROM (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 49, 0))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents) u) y),
q AS (SELECT DISTINCT doc_id FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1))
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(z.m, 0) AS BIGINT) AS n_removed, coalesce(z.c, 0) AS n_spans, sha256(unhex(j.h)) AS kept_sha256, q.doc_id IS NOT NULL AS repeats_passage FROM d LEFT JOIN q ON q.doc_id = d.doc_id JOIN j ON j.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS m, count(*) AS c FROM s GROUP BY doc_id) z ON z.doc_id = d.doc_id
"""
