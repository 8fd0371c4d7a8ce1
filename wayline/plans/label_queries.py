"""Labels of guide lines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..sources.lenses import TRACK_SQL, hav_sql, track


def guide_labels(spark, d):
    """Each ride's first twelve fixes as the line back to its start, on maps of several zooms, turned by the ride."""
    t = track(spark, d).where("seq < 12")
    v = t.select(F.col("ride_id").alias("id")).distinct().select("id", (F.lit(14.0) + F.col("id") % 5).alias("zoom"), (F.col("id") * 47 % 360).alias("bearing"), F.lit(390).alias("width"), F.lit(700).alias("height"), F.lit(60).alias("top"), (F.col("id") % 3 * 80).alias("bottom"), F.lit(0).alias("left"), F.lit(20).alias("right"), F.lit(50.0).alias("hide_m"))
    out = L.guide_labels(t.select(F.col("ride_id").alias("id"), F.col("seq").alias("i"), "lat", "lng"), v)
    return out.select("id", "shown", *[F.round(c, 6).alias(c) for c in ("lat", "lng")], F.round("meters", 3).alias("meters"))


LABELS_SQL = f"""WITH {TRACK_SQL},
p AS (SELECT ride_id AS id, seq AS i, lat, lng, (lng + 180) / 360 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 AS y, 512 * pow(2, 14 + ride_id % 5) AS s, radians(ride_id * 47 % 360) AS b, 390 AS w, 700 AS h, 60 AS t, ride_id % 3 * 80 AS bo FROM track WHERE seq < 12),
d AS (SELECT *, row_number() OVER v AS n, lag(x) OVER v AS ox, lag(y) OVER v AS oy, coalesce((x - lag(x) OVER v) * s, 0) AS dx, coalesce((y - lag(y) OVER v) * s, 0) AS dy FROM p WINDOW v AS (PARTITION BY id ORDER BY i DESC)),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS px, dx * cos(b) + dy * sin(b) AS sx, dy * cos(b) - dx * sin(b) AS sy FROM d),
a AS (SELECT *, sum(px) OVER v AS along, (w + 0 - 20) / 2 + sum(sx) OVER v - sx AS ax, t + (h - t - bo) / 2 + sum(sy) OVER v - sy AS ay FROM e WINDOW v AS (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, least(CASE WHEN sx > 0 THEN (w - ax) / sx WHEN sx < 0 THEN -ax / sx ELSE 'inf'::DOUBLE END, CASE WHEN sy > 0 THEN (h - ay) / sy WHEN sy < 0 THEN -ay / sy ELSE 'inf'::DOUBLE END) AS leave FROM a),
g AS (SELECT id, max(along) AS total, count(*) AS c, arg_min(along - px + leave * px, n) FILTER (px > 0 AND leave <= 1) AS edge, arg_max(lat, i) AS rlat, arg_max(lng, i) AS rlng, arg_min(lat, i) AS glat, arg_min(lng, i) AS glng FROM o GROUP BY id),
k AS (SELECT o.*, total, {hav_sql('rlat', 'rlng', 'glat', 'glng')} AS meters, least(total, coalesce(edge, total)) / 2 AS half, c FROM o JOIN g USING (id)),
f AS (SELECT * FROM k WHERE n > 1 AND (along >= half OR n = c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1),
m AS (SELECT *, CASE WHEN px > 0 THEN least(1, (half - along + px) / px) ELSE 0 END AS u, meters > 50 AND total >= 70 AS shown FROM f)
SELECT id, shown, CASE WHEN shown THEN round(degrees(atan(sinh((1 - (oy + (y - oy) * u) * 2) * pi()))), 6) END AS lat, CASE WHEN shown THEN round((ox + (x - ox) * u) * 360 - 180, 6) END AS lng, round(meters, 3) AS meters FROM m
"""

QUERIES = {"guide_labels": (guide_labels, LABELS_SQL)}
