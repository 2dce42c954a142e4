"""Checking SQL (DuckDB) of queries with exact results, written against the definition of these results."""

_FINITE = """
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

# Sums run over the components in order, as in the query.
_PRODUCT = "list_reduce(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]), lambda s, t: s + t)"

NEAREST = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE {_FINITE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.n, a.vec_id AS query_id, b.vec_id AS vec_id, {_PRODUCT} AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.n <> b.n AND len(a.e) = len(b.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM pairs
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

HARD_NEGATIVES = f"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE {_FINITE} AND label IS NOT NULL
), pairs AS (
  SELECT a.n, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST({_PRODUCT} AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.n <> b.n AND len(a.e) = len(b.e)
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, other_id) AS place FROM pairs WHERE same
), ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, g.other_id AS negative_id, p.score AS positive_score, g.score AS negative_score,
         row_number() OVER (PARTITION BY p.n, p.place ORDER BY g.score DESC, g.other_id) AS rank
  FROM positives p JOIN pairs g ON p.n = g.n AND NOT g.same
   AND 80 * p.score <= 100 * g.score AND 100 * g.score <= 100 * p.score
  WHERE p.place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""

# Links between rows, both ways, and all rows that hang together with one.
_REACHED = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a AS n, b AS m FROM both_ways
  UNION
  SELECT r.n, l.b FROM reached r JOIN both_ways l ON r.m = l.a
),
counted AS (SELECT a AS n, count(*) AS n_links FROM both_ways GROUP BY a)"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS n, * FROM embeddings),
v AS (
  SELECT n, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM every
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
sized AS (SELECT *, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, t: s + t)) AS size FROM v),
links AS (
  SELECT a.n AS a, b.n AS b FROM sized a JOIN sized b ON a.n < b.n AND len(a.e) = len(b.e)
  WHERE a.e = b.e OR {_PRODUCT} / (a.size * b.size) >= 0.9
),
{_REACHED},
least AS (SELECT r.n, min(o.vec_id) AS vec_id FROM reached r JOIN every o ON o.n = r.m GROUP BY r.n)
SELECT every.vec_id, coalesce(n_links, 0) AS n_links,
       CASE WHEN every.vec_id IS NOT NULL THEN least(every.vec_id, coalesce(least.vec_id, every.vec_id)) END AS component_id,
       coalesce(every.vec_id <= coalesce(least.vec_id, every.vec_id), TRUE) AS kept
FROM every LEFT JOIN counted USING (n) LEFT JOIN least USING (n)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(lower(coalesce(text, '')), '\\S+') AS w FROM documents
),
s AS (
  SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS grams
  FROM d
),
g AS (SELECT n, unnest(grams) AS gram FROM s),
pairs AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.n < b.n GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN s x ON x.n = p.a JOIN s y ON y.n = p.b
  WHERE 5 * common >= 4 * (len(x.grams) + len(y.grams) - common)
),
{_REACHED},
least AS (SELECT r.n, min(o.doc_id) AS doc_id FROM reached r JOIN d o ON o.n = r.m GROUP BY r.n)
SELECT d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN least(d.doc_id, coalesce(least.doc_id, d.doc_id)) END AS class_id,
       coalesce(n_links, 0) AS n_links, coalesce(d.doc_id <= coalesce(least.doc_id, d.doc_id), TRUE) AS kept
FROM d LEFT JOIN counted USING (n) LEFT JOIN least USING (n)
"""
