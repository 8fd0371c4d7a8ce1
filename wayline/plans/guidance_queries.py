"""Queries for guidance and rows of planned routes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import guidance as G
from ..sources.lenses import FIX_SQL, RIDE_SQL, fix, hav_sql, read, ride


def guidance_kinds(spark, d):
    c = read(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 3 = 0 AS asked", "IF(c_custkey % 7 = 0, NULL, c_custkey % 2 = 0) AS ready", "c_custkey % 5 <> 0 AS allowed", "c_custkey % 4 <> 0 AS plan", "c_custkey % 6 = 0 AS finished", "c_custkey % 8 <> 3 AS wanted")
    return c.select("id", G.guidance_kind(*[F.col(x) for x in ("asked", "ready", "allowed", "plan", "finished", "wanted")]).alias("kind"))


def _steps(spark, d):
    o = read(spark, d, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    return o.selectExpr("o_custkey AS id", "i", "i * 120D + o_orderkey % 50 AS along", "CASE WHEN o_orderkey % 11 = 0 THEN 'arrive' WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS turn", "40D + o_orderkey % 1009 * 0.0001D AS lat", "-105D + o_orderkey % 997 * 0.0001D AS lng")


def banners(spark, d):
    r = read(spark, d, "customer").selectExpr("c_custkey AS id", "40D + c_custkey % 1013 * 0.0001D AS lat", "-105D + c_custkey % 991 * 0.0001D AS lng", "c_custkey % 40 / 10D AS speed", "IF(c_custkey % 19 = 0, NULL, double(c_custkey * 29 % 360)) AS heading", "double(c_custkey * 13 % 1300) AS along", "c_custkey % 9 = 0 AS off_route", "double(c_custkey % 5000) AS target_meters", "40.05D AS target_lat", "-104.95D AS target_lng")
    return G.banners(r, _steps(spark, d)).select("id", "icon", "turn_around", "turn", "after_turn", F.round("distance", 4).alias("distance"), F.round("progress", 6).alias("progress"))


def steps_to_stop(spark, d):
    r = read(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 5 AS next_point", "c_custkey % 5 + IF(c_custkey % 3 = 0, 0, 2) AS stop_point", "500D + c_custkey % 100 AS live_total", "300D AS from_m", "900D + c_custkey % 50 AS to_m")
    plan = read(spark, d, "orders").where("o_orderkey % 2 = 0").selectExpr("o_custkey AS id", "double(o_orderkey * 37 % 1500) AS along", "IF(o_orderkey % 13 = 0, 'arrive', 'left') AS turn")
    return G.steps_to_stop(r, _steps(spark, d), plan)


def same_hills(spark, d):
    c = fix(spark, d).selectExpr("ride_id", "seq", "seq * 20D AS along", "IF(seq % 7 = 3, NULL, seq div 6 * 130D + seq * 13 % 40) AS start")
    return G.same_hills(c.withColumn("stop", F.expr("start + 60 + seq * 7 % 50")))


def route_lines(spark, d):
    g = read(spark, d, "lineitem").selectExpr("l_orderkey AS route_id", "l_linenumber AS i", "transform(sequence(0, int(1 + l_partkey % 3)), x -> named_struct('lng', (l_partkey + x) / 8D, 'lat', (l_linenumber + x) / 16D)) AS coords", "double(l_quantity) * 10.25D AS meters", "l_linenumber % 5 = 0 AS pending")
    r = G.assembled(g)
    return r.select("route_id", F.size("coords").alias("n"), F.aggregate("coords", F.lit(0.0), lambda s, p: s + p.lat).alias("lat"), "meters", "profile_key", "measurable")


def saved_routes(spark, d):
    s = read(spark, d, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "concat('Route ', c_custkey) AS name", "1000 AS updated", "5 AS n_points", "double(c_custkey) AS meters")
    e = read(spark, d, "orders").selectExpr("o_custkey AS id", "IF(o_orderkey % 5 = 0, '', concat('Edit ', o_orderkey)) AS name", "int(900 + o_orderkey % 300) AS updated", "int(o_orderkey % 4) AS n_points", "double(o_orderkey) AS meters", "o_orderkey % 3 = 0 AS preview", "o_orderkey % 97 = 0 AS deleted")
    return G.saved(s, e)


def imported_routes(spark, d):
    """Files with a track, with points or with both, some as drawn, some between points (every other of the track)."""
    o = read(spark, d, "orders").selectExpr("o_orderkey AS id", "IF(o_orderkey % 4 = 0, NULL, sequence(0, int(o_orderkey % 9 + 1))) AS track", "IF(o_orderkey % 4 = 1, NULL, sequence(0, int(o_orderkey % 5))) AS points")
    got = G.imported(o, F.col("id") % 3 == 0, F.filter("track", lambda p, k: k % 2 == 0))
    ends = F.aggregate("legs", F.lit(0), lambda s, g: s + F.element_at(g, -1))
    return got.select("id", "source", F.size("waypoints").alias("n_waypoints"), F.size("legs").alias("n_legs"), ends.alias("ends"))


def finalised_rides(spark, d):
    c = ride(spark, d).selectExpr("id AS ride_id", "IF(id % 9 = 0, '', activity) AS activity", "IF(id % 5 = 0, NULL, total_distance) AS total_distance", "IF(id % 6 = 0, NULL, moving_time_ms) AS moving_time_ms", "IF(id % 2 = 0, NULL, array(named_struct('start', start_ms, 'stop', start_ms + 1000))) AS pauses", "IF(id % 7 = 0, end_ms - 5000, NULL) AS pause_started_ms", "id % 4 AS n_points")
    out = G.finalised(c, F.lit(900_000_000_000).cast("long"))
    return out.select("ride_id", "activity", F.round("total_distance", 4).alias("total_distance"), "moving_time_ms", F.round("avg_speed", 6).alias("avg_speed"), F.size("pauses").alias("n_pauses"))


_STEPS = "WITH st AS (SELECT o_custkey AS id, i, i * 120 + o_orderkey % 50 AS along, CASE WHEN o_orderkey % 11 = 0 THEN 'arrive' WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS turn, 40 + (o_orderkey % 1009) * 0.0001::DOUBLE AS lat, -105 + (o_orderkey % 997) * 0.0001::DOUBLE AS lng FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders))"
_BEARING = "degrees(atan2(sin(radians(tlng - lng)) * cos(radians(tlat)), cos(radians(lat)) * sin(radians(tlat)) - sin(radians(lat)) * cos(radians(tlat)) * cos(radians(tlng - lng))))"
QUERIES = {
    "guidance_kinds": (guidance_kinds, "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'home' WHEN c_custkey % 4 <> 0 AND c_custkey % 6 <> 0 AND c_custkey % 8 <> 3 THEN 'route' END AS kind FROM customer"),
    "banners": (banners, _STEPS + ", r AS (SELECT c_custkey AS id, 40 + (c_custkey % 1013) * 0.0001::DOUBLE AS lat, -105 + (c_custkey % 991) * 0.0001::DOUBLE AS lng, (c_custkey % 40) / 10 AS speed, CASE WHEN c_custkey % 19 <> 0 THEN c_custkey * 29 % 360 END AS heading, c_custkey * 13 % 1300 AS along, c_custkey % 9 = 0 AS off, c_custkey % 5000 AS target FROM customer), f AS (SELECT id, min(i) AS f FROM st JOIN r USING (id) WHERE st.along > r.along + 1 GROUP BY id), "
    "j AS (SELECT r.*, coalesce(n.lat, 40.05::DOUBLE) AS tlat, coalesce(n.lng, -104.95::DOUBLE) AS tlng, n.along AS na, n.turn AS nt, a.turn AS xt, coalesce(p.along, 0) AS pa FROM r LEFT JOIN f USING (id) LEFT JOIN st n ON n.id = r.id AND n.i = f LEFT JOIN st p ON p.id = r.id AND p.i = f - 1 LEFT JOIN st a ON a.id = r.id AND a.i = f + 1), "
    "b AS (SELECT *, abs(" + _BEARING + " - heading) AS d, " + hav_sql("lat", "lng", "tlat", "tlng") + " AS m FROM j), t AS (SELECT *, coalesce(speed >= 1.5 AND m >= 25 AND least(d - 360 * floor(d / 360), 360 - d + 360 * floor(d / 360)) > 120, false) AS away FROM b) SELECT id, CASE WHEN off THEN 'reroute' WHEN away THEN 'uturn' ELSE coalesce(nt, 'straight') END AS icon, away AND NOT off AS turn_around, CASE WHEN NOT off THEN nt END AS turn, CASE WHEN NOT off AND nt <> 'arrive' THEN xt END AS after_turn, round(coalesce(na - along, target)::DOUBLE, 4) AS distance, round(CASE WHEN na IS NULL THEN 0::DOUBLE ELSE greatest(0, least(1, (along - pa) / greatest(1, na - pa))) END, 6) AS progress FROM t"),
    "steps_to_stop": (steps_to_stop, _STEPS + ", r AS (SELECT c_custkey AS id, c_custkey % 3 = 0 AS direct, 500 + c_custkey % 100 AS live, 900 + c_custkey % 50 AS too FROM customer), pl AS (SELECT o_custkey AS id, o_orderkey * 37 % 1500 AS along, CASE WHEN o_orderkey % 13 = 0 THEN 'arrive' ELSE 'left' END AS turn FROM orders WHERE o_orderkey % 2 = 0) SELECT id, st.along::DOUBLE AS along, turn FROM st JOIN r USING (id) WHERE direct OR turn <> 'arrive' UNION ALL SELECT id, (along + live - 300)::DOUBLE, turn FROM pl JOIN r USING (id) WHERE NOT direct AND turn <> 'arrive' AND along >= 295 AND along < too - 1 UNION ALL SELECT id, (too + live - 300)::DOUBLE, 'arrive' FROM r WHERE NOT direct AND id IN (SELECT id FROM pl)"),
    "same_hills": (same_hills, "WITH RECURSIVE " + FIX_SQL + ", c AS (SELECT ride_id, seq, seq * 20 AS along, CASE WHEN seq % 7 <> 3 THEN (seq // 6 * 130 + seq * 13 % 40)::DOUBLE END AS a, CASE WHEN seq % 7 <> 3 THEN (seq // 6 * 130 + seq * 13 % 40 + 60 + seq * 7 % 50)::DOUBLE END AS z FROM fix), g(ride_id, seq, hill, s, e) AS (SELECT ride_id, seq, CASE WHEN a IS NOT NULL THEN 0::BIGINT END, a, z FROM c WHERE seq = 0 UNION ALL SELECT ride_id, seq, CASE WHEN fresh THEN coalesce(hill + 1, 0) ELSE hill END, CASE WHEN fresh THEN a ELSE s END, CASE WHEN fresh OR same THEN z ELSE e END FROM (SELECT *, coalesce(NOT same AND a IS NOT NULL AND (hill IS NULL OR along > e), false) AS fresh FROM (SELECT c.*, g.hill, g.s, g.e, coalesce(c.a <= g.e + 40 AND c.z >= g.s - 40, false) AS same FROM g JOIN c ON c.ride_id = g.ride_id AND c.seq = g.seq + 1))) SELECT ride_id, seq, hill, s AS start, e AS stop FROM g"),
    "route_lines": (route_lines, "WITH g AS (SELECT l_orderkey AS route_id, l_linenumber AS i, 2 + l_partkey % 3 AS n, l_quantity::DOUBLE * 10.25::DOUBLE AS m, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > 1 AS later FROM lineitem), s AS (SELECT route_id, sum(n - later::INT)::INT AS n, sum((n * i + n * (n - 1) / 2 - CASE WHEN later THEN i ELSE 0 END) / 16) AS lat, sum(m) AS meters, bool_or(i % 5 = 0) AS waiting FROM g GROUP BY route_id) SELECT route_id, n, lat, meters, n || ':' || floor(meters + 0.5)::BIGINT AS profile_key, NOT waiting AS measurable FROM s"),
    "saved_routes": (saved_routes, "WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), e AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Untitled route' ELSE 'Edit ' || o_orderkey END AS name, (900 + o_orderkey % 300)::INT AS updated, (o_orderkey % 4)::INT AS n_points, o_orderkey::DOUBLE AS meters FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 97 <> 0 AND (o_orderkey % 4 > 0 OR o_custkey IN (SELECT id FROM s))), b AS (SELECT *, 1 AS new FROM e UNION ALL SELECT id, 'Route ' || id, 1000, 5, id::DOUBLE, 0 FROM s) SELECT id, name, updated, n_points, meters FROM b WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 97 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated DESC, new DESC, name DESC, n_points DESC, meters DESC) = 1"),
    "imported_routes": (imported_routes, "WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN range(0, o_orderkey % 9 + 2) END AS track, range(0, o_orderkey % 9 + 2, 2) AS thin, CASE WHEN o_orderkey % 4 <> 1 THEN range(0, o_orderkey % 5 + 1) END AS points FROM orders), p AS (SELECT id, id % 3 = 0 AS drawn, coalesce(track, points) AS line, coalesce(points, thin) AS pts FROM o) SELECT id, CASE WHEN drawn THEN 'gpx' ELSE 'planned' END AS source, CASE WHEN drawn THEN 0 ELSE len(pts) END::INT AS n_waypoints, CASE WHEN drawn THEN 1 ELSE len(pts) - 1 END::INT AS n_legs, CASE WHEN drawn THEN line[-1] ELSE list_sum(pts) END::INT AS ends FROM p"),
    "finalised_rides": (finalised_rides, "WITH " + RIDE_SQL + ", c AS (SELECT id, activity, end_ms, CASE WHEN id % 5 = 0 THEN 0 ELSE total_distance END AS m, CASE WHEN id % 6 = 0 THEN 0 ELSE moving_time_ms END AS ms FROM ride WHERE id % 4 >= 2) SELECT id AS ride_id, CASE WHEN id % 9 = 0 OR activity IS NULL THEN 'bike' ELSE activity END AS activity, round(m, 4) AS total_distance, ms AS moving_time_ms, round(CASE WHEN ms > 0 THEN m / (ms / 1000) ELSE 0 END, 6) AS avg_speed, ((id % 2 <> 0)::INT + coalesce((id % 7 = 0 AND end_ms - 5000 < 900000000000)::INT, 0))::INT AS n_pauses FROM c"),
}
