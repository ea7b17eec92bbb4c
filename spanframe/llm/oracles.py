"""DuckDB SQL for the numbered queries that SQL can express; the others are tested against brute force in tests/llm."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS k, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows x ON p.n = x.n AND array_to_string(w[i:i + p.n - 1], ' ') = x.k),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

OP3 = r"""
WITH l AS (SELECT doc_id, unnest(range(len(s))) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
t AS (SELECT *, regexp_full_match(line, '[ \t\r\x0b\x0c]*') AS blank FROM l),
f AS (SELECT line, min((doc_id, no)) AS first FROM t WHERE NOT blank GROUP BY line),
v AS (SELECT line, first, pos, md5(left(line, pos - 1) || substr(line, pos + 1)) AS k FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS pos FROM f)),
near AS (SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY k, pos) AS m FROM v) WHERE m < first
  UNION SELECT v.line FROM v JOIN f ON md5(f.line) = v.k WHERE f.first < v.first
  UNION SELECT f.line FROM v JOIN f ON md5(f.line) = v.k WHERE v.first < f.first),
judged AS (SELECT t.*, blank OR (f.first = (doc_id, no) AND near.line IS NULL) AS stays FROM t LEFT JOIN f ON f.line = t.line LEFT JOIN near ON near.line = t.line)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(g, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(j.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (NOT stays) AS g, string_agg(line, chr(10) ORDER BY no) FILTER (stays) AS text FROM judged GROUP BY 1) j ON j.doc_id = d.doc_id"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


_ROUND = """
d{n} AS MATERIALIZED (SELECT x.vec_id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS far FROM x JOIN b{m} b USING (p)),
a{n} AS MATERIALIZED (SELECT vec_id, p, e, far FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, p ORDER BY far, e) AS r FROM d{n}) WHERE r = 1)"""
_MOVE = """
m{n} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n
  FROM (SELECT a.p, a.e, unnest(range(1, len(x.v) + 1)) AS i, unnest(x.v) AS c FROM a{n} a JOIN x USING (vec_id, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{m} b LEFT JOIN m{n} m USING (p, e))"""

OP11 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM k, (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) USING (vec_id) WHERE e < 64),{_ROUND.format(n=1, m=0)},{_MOVE.format(n=1, m=0)},{_ROUND.format(n=2, m=1)},{_MOVE.format(n=2, m=1)},{_ROUND.format(n=3, m=2)},
c AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a3 GROUP BY 1),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), books"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
