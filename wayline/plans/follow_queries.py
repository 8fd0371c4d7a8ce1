"""Queries for following a line and for prompts, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.lenses import FIX_SQL, fix, hav_sql
from ..streaming import follow

LINE = [(40 + i * 0.00025, -104.9995 + (0.0003 if i % 2 else -0.0002)) for i in range(48)]


def line_progress(spark, d):
    """Rides along a zigzag that they cross, and that they leave."""
    f = fix(spark, d).withColumn("lng", F.col("lng") + F.when(F.col("seq").between(30, 40), 0.0008).otherwise(0.0))
    out = follow.track_line(f, LINE)
    return out.select("ride_id", "seq", F.round("along", 3).alias("along"), F.round("meters", 3).alias("meters"), "off_route", "progress")


def _prompts(spark, d):
    kind = F.when(F.col("seq") % 5 < 2, "turn").when(F.col("seq") % 5 == 2, "reroute").when(F.col("seq") % 5 == 3, "turn_around").otherwise("heads_up")
    key = F.when(kind == "turn", F.concat((F.col("seq") / 20).cast("int"), F.lit(":"), F.when(F.col("seq") % 2 == 0, "early").otherwise("now"))).otherwise("")
    return fix(spark, d).select("ride_id", "seq", F.col("t_ms"), kind.alias("kind"), key.alias("key"), (F.col("seq") * 997 % 7000).alias("age_ms"))


def spoken_prompts(spark, d):
    return follow.spoken(_prompts(spark, d)).select("ride_id", "seq", "kind", "key")


def reevaluations(spark, d):
    f = fix(spark, d)
    return follow.moved(f, 10.0).withColumn("meters", F.lit(10)).unionByName(follow.moved(f, 15.0).withColumn("meters", F.lit(15)))


_LINE_SQL = (
    "WITH RECURSIVE " + FIX_SQL + ", f AS (SELECT ride_id, seq, lat, lng + CASE WHEN seq BETWEEN 30 AND 40 THEN 0.0008::DOUBLE ELSE 0 END AS lng FROM fix), v AS (SELECT i, 40 + i * 0.00025::DOUBLE AS lat, -104.9995::DOUBLE + CASE WHEN i % 2 = 1 THEN 0.0003::DOUBLE ELSE -0.0002::DOUBLE END AS lng FROM range(48) t(i)), s0 AS (SELECT i, lat AS alat, lng AS alng, lead(lat) OVER (ORDER BY i) AS blat, lead(lng) OVER (ORDER BY i) AS blng FROM v), s1 AS (SELECT *, " + hav_sql("alat", "alng", "blat", "blng") + " AS m FROM s0 WHERE blat IS NOT NULL), sg AS (SELECT *, sum(m) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - m AS d0 FROM s1), "
    "h0 AS (SELECT f.ride_id, f.seq, f.lat, f.lng, sg.*, cos(radians(f.lat)) AS k FROM f, sg), h1 AS (SELECT ride_id, seq, i, d0, m, f_lat AS lat, f_lng AS lng, alat, alng, blat, blng, greatest(0, least(1, -((alng - f_lng) * k * (blng - alng) * k + (alat - f_lat) * (blat - alat)) / (pow((blng - alng) * k, 2) + pow(blat - alat, 2)))) AS u FROM (SELECT ride_id, seq, i, d0, m, alat, alng, blat, blng, k, lat AS f_lat, lng AS f_lng FROM h0)), "
    "h AS (SELECT ride_id, seq, i, d0, d0 + u * m AS along, " + hav_sql("lat", "lng", "(alat + (blat - alat) * u)", "(alng + (blng - alng) * u)") + " AS far FROM h1), "
    "r(ride_id, seq, along, far, progress) AS (SELECT DISTINCT ride_id, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::BIGINT FROM f UNION ALL SELECT q.ride_id, q.seq, q.b.along, q.b.far, CASE WHEN q.b.far <= 35 THEN q.b.i ELSE q.progress END FROM (SELECT h.ride_id, h.seq, r.progress, arg_min({'i': h.i, 'along': h.along, 'far': h.far}, {'d': round(h.far, 6), 'i': h.i}) AS b FROM r JOIN h ON h.ride_id = r.ride_id AND h.seq = r.seq + 1 JOIN sg p ON p.i = r.progress WHERE h.i >= r.progress AND (h.i = r.progress OR h.d0 - p.d0 <= 500) GROUP BY h.ride_id, h.seq, r.progress) q) SELECT ride_id, seq, round(along, 3) AS along, round(far, 3) AS meters, far > 35 AS off_route, progress FROM r WHERE seq >= 0"
)
_SPOKEN_SQL = (
    "WITH RECURSIVE " + FIX_SQL + ", p AS (SELECT ride_id, seq, t_ms, CASE WHEN seq % 5 < 2 THEN 'turn' WHEN seq % 5 = 2 THEN 'reroute' WHEN seq % 5 = 3 THEN 'turn_around' ELSE 'heads_up' END AS kind, CASE WHEN seq % 5 < 2 THEN (seq // 20) || CASE WHEN seq % 2 = 0 THEN ':early' ELSE ':now' END ELSE '' END AS key FROM fix WHERE seq * 997 % 7000 <= 6000), "
    "o AS (SELECT ride_id, seq, kind, key FROM p WHERE kind IN ('turn', 'heads_up') QUALIFY row_number() OVER (PARTITION BY ride_id, kind, key ORDER BY t_ms, seq) = 1), l AS (SELECT *, row_number() OVER (PARTITION BY ride_id, kind ORDER BY t_ms, seq) AS n FROM p WHERE kind IN ('reroute', 'turn_around')), "
    "g AS (SELECT ride_id, kind, seq, n, t_ms AS said, true AS let FROM l WHERE n = 1 UNION ALL SELECT l.ride_id, l.kind, l.seq, l.n, CASE WHEN l.t_ms - g.said >= CASE l.kind WHEN 'reroute' THEN 60000 ELSE 120000 END THEN l.t_ms ELSE g.said END, l.t_ms - g.said >= CASE l.kind WHEN 'reroute' THEN 60000 ELSE 120000 END FROM g JOIN l ON l.ride_id = g.ride_id AND l.kind = g.kind AND l.n = g.n + 1) SELECT * FROM o UNION ALL SELECT ride_id, seq, kind, '' FROM g WHERE let"
)
_MOVED_SQL = (
    "WITH RECURSIVE " + FIX_SQL + ", m AS (SELECT unnest([10, 15]) AS meters), g AS (SELECT m.meters, ride_id, seq, lat, lng, true AS let FROM fix, m WHERE seq = 0 UNION ALL SELECT meters, ride_id, seq, CASE WHEN let THEN nlat ELSE lat END, CASE WHEN let THEN nlng ELSE lng END, let FROM (SELECT g.meters, f.ride_id, f.seq, g.lat, g.lng, f.lat AS nlat, f.lng AS nlng, " + hav_sql("g.lat", "g.lng", "f.lat", "f.lng") + " >= g.meters AS let FROM g JOIN fix f ON f.ride_id = g.ride_id AND f.seq = g.seq + 1) x) SELECT ride_id, seq, meters FROM g WHERE let"
)

QUERIES = {
    "line_progress": (line_progress, _LINE_SQL),
    "spoken_prompts": (spoken_prompts, _SPOKEN_SQL),
    "reevaluations": (reevaluations, _MOVED_SQL),
}
