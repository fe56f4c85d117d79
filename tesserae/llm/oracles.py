"""SQL for those of the ten operators that SQL expresses at a bearable cost, for DuckDB."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS z FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.z, r.z)::BIGINT AS score FROM v q JOIN v r ON r.vec_id != q.vec_id AND len(r.z) = len(q.z) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s) WHERE rank <= 5"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[k : k + 4], ' ') for k in range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS same FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * same >= 80 * (nu + nv - same)),
t AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach(a, b) AS (SELECT u, v FROM t UNION SELECT reach.a, t.v FROM reach JOIN t ON reach.b = t.u)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM g"""

SUBSTRING = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
h AS (SELECT doc_id, unnest([md5(array_to_string(ws[k : k + 49], ' ')) for k in range(1, len(ws) - 48)]) AS g, unnest(range(1, len(ws) - 48)) AS k FROM w WHERE len(ws) >= 50),
f AS (SELECT g, min(doc_id) AS d FROM h GROUP BY 1),
r AS (SELECT DISTINCT doc_id, p FROM (SELECT h.doc_id, unnest(range(k, k + 50)) AS p FROM h JOIN f USING (g) WHERE d < h.doc_id)),
a AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
o AS (SELECT doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY p) AS t FROM a WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = a.doc_id AND r.p = a.p) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(kept, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)"""

BYTES = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, x, unnest(range(0, octet_length(x) - 399)) AS p FROM d WHERE octet_length(x) >= 400),
g AS (SELECT doc_id, p, md5(x[p + 1 : p + 400]) AS h FROM w),
r AS (SELECT doc_id, p FROM g WHERE h IN (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM s),
b AS (SELECT doc_id, k, min(p) AS a, max(p) + 400 AS z FROM i GROUP BY 1, 2),
c AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM b),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(hex(x[y + 1 : a]), '' ORDER BY a) || any_value(hex(x[last + 1 : octet_length(x)])) AS kept
  FROM c JOIN d USING (doc_id) JOIN (SELECT doc_id, max(z) AS last FROM b GROUP BY 1) USING (doc_id) GROUP BY 1)
SELECT doc_id, octet_length(x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hex(x)))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
