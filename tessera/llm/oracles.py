"""SQL for the other engine, of the operators on vectors and of mixing: plain all-pairs statements of the same results."""

from __future__ import annotations

OP6_SQL = """
WITH fit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM fit q JOIN fit c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""

OP11_SQL = """
WITH fit AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
  FROM fit a JOIN fit c ON a.id <> c.id AND len(a.v) = len(c.v)
  WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), banded AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS nth
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM banded WHERE nth <= 3
"""

#: A round of op12: the nearest centroid of each vector by (squared distance, number), and each centroid's next place.
_ASSIGN = """a{i} AS MATERIALIZED (
  SELECT row, any_value(v) AS v, any_value(vec_id) AS vec_id, arg_min(n, d * 8 + n) AS cluster, min(d) AS distance FROM (
    SELECT f.row, f.v, f.vec_id, c.n, CAST(list_sum(list_transform(range(1, 65), lambda i: (f.v[i] - c.v[i]) * (f.v[i] - c.v[i]))) AS BIGINT) AS d FROM fit f, c{i} c
  ) GROUP BY row
)"""
_MOVE = """c{j} AS MATERIALIZED (
  SELECT c.n, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % k + k) % k)) // k AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY cluster, i
    ) GROUP BY cluster
  ) m ON c.n = m.cluster
)"""


def op12_sql(rounds: int = 10) -> str:
    steps = [x for i in range(rounds) for x in (_ASSIGN.format(i=i), _MOVE.format(i=i, j=i + 1))]
    return f"""
WITH fit AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INTEGER) AS n, v
  FROM (SELECT sha256('3:' || vec_id) AS key, min(v) AS v FROM fit WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY key LIMIT 8)
), {", ".join(steps)}, {_ASSIGN.format(i=rounds)}
SELECT vec_id, a.cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.n
"""


OP13_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS HUGEINT) AS full_size,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, coalesce(sum(full_size) OVER w, 0) AS below, coalesce(sum(weight) OVER w, 0) AS weight_below, sum(source_size) OVER () * 150 AS share, sum(weight) OVER () AS weights
  FROM sources WINDOW w AS (ORDER BY full_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, full_size * 100 * (weights - weight_below) <= weight * (share - below * 100) AS is_full FROM steps
), rests AS (
  SELECT *, share - 100 * coalesce(sum(full_size) FILTER (is_full) OVER (), 0) AS rest,
    100 * greatest(1, weights - coalesce(sum(weight) FILTER (is_full) OVER (), 0)) AS parts
  FROM marked
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(full_size AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(parts AS DOUBLE) END AS target,
    CASE WHEN is_full THEN CAST(full_size AS BIGINT) ELSE CAST((weight * rest) // parts AS BIGINT) END AS budget
  FROM rests
), placed AS (
  SELECT s.*, t.source_size, target, budget, CASE WHEN t.source_size > 0 THEN budget // t.source_size ELSE 0 END AS rounds,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, greatest(0, least(size, budget - rounds * source_size - before)) AS last FROM placed
)
SELECT doc_id, source, size, source_size, target, CAST(rounds * size + last AS BIGINT) AS taken, CAST(rounds + CAST(last > 0 AS BIGINT) AS BIGINT) AS epochs FROM cut
"""
