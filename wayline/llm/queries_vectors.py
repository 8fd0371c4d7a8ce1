"""The numbered queries over `embeddings`, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroid_clustering, hard_negatives
from .common import table


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.digest(*centroid_clustering.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")))


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering, "op12_hard_negatives": op12_hard_negatives}


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    near = """d{i} AS MATERIALIZED (
  SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d2 FROM comp v JOIN m{i} m USING (dim) GROUP BY vec_id, c),
a{i} AS MATERIALIZED (
  SELECT vec_id, c, d2 FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, c) = 1)"""
    move = """m{j} AS MATERIALIZED (
  SELECT m.c, m.dim, coalesce(s.x, m.x) AS x FROM m{i} m LEFT JOIN (
    SELECT c, dim, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
    FROM comp JOIN a{i} USING (vec_id) GROUP BY c, dim) s USING (c, dim))"""
    steps = []
    for i in range(rounds + 1):
        steps.append(near.format(i=i))
        if i < rounds:
            steps.append(move.format(i=i, j=i + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
comp AS MATERIALIZED (
  SELECT vec_id, dim, CAST(floor(256 * CAST(embedding[dim] AS DOUBLE)) AS BIGINT) AS x
  FROM kept CROSS JOIN (SELECT unnest(range(1, 65)) AS dim)),
m0 AS MATERIALIZED (
  SELECT c, dim, x FROM comp JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {k}) USING (vec_id)),
{",".join(steps)},
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d2 AS BIGINT) AS distance,
  CAST(sum(d2) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d2) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN h USING (c)"""


_HARD_NEGATIVES = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
QUALIFY rank <= 10"""

ORACLES = {"op11_centroid_clustering": _clustering_sql(), "op12_hard_negatives": _HARD_NEGATIVES}
