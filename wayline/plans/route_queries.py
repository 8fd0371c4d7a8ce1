"""Queries for sections, junctions, names, slopes, colours, titles and rows of routes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lines as L
from ..operators import reduce as P
from ..operators import routes as R
from ..operators import tracks as T
from ..sources import exchange as E
from ..sources.lenses import FIX_SQL, RIDE_SQL, STEP_SQL, fix, pause, read, ride
from .kernel_queries import _GREEDY
from .line_queries import _RS


def _samples(spark, d):
    f = fix(spark, d)
    ran = T.running(T.moving(T.steps(f), pause(f)))
    return L.resampled(ran.where("altitude IS NOT NULL"))


def _round(name: str, n: int) -> F.Column:
    return F.round(F.col(name) + 1e-9, n).alias(name)


def slope_ahead(spark, d):
    """The first slope and the first climb of every ride's profile, its heights halved."""
    s = _samples(spark, d).select("ride_id", "k", (F.col("altitude") / 2).alias("altitude"))
    both = [R.slopes_ahead(s, climbs_only=c).select("ride_id", F.lit(c).alias("climbs_only"), "start", "stop", _round("grade", 6)) for c in (False, True)]
    return both[0].unionByName(both[1])


def pace_colours(spark, d):
    f = fix(spark, d)
    t = F.col("speed") / 30 - 0.2
    band = C.speed_band(F.col("speed"), F.lit(40.0))
    return f.select("ride_id", "seq", C.pace_colour(t).alias("pace"), C.pace_colour((band + 0.5) / 16).alias("band"), C.grade_colour((F.col("altitude") - 125) / 200).alias("grade"))


def ride_titles(spark, d):
    r = ride(spark, d)
    start = F.expr("date + make_dt_interval(0, 0, 0, (id * 997) % 86400)")
    part = C.day_part(start, F.expr("date + make_dt_interval(0, 0, 0, (id * 997) % 86400 + moving_time_ms div 1000)"))
    part = F.when(F.col("id") % 50 != 0, part)
    return r.select("id", C.ride_title(part, F.col("activity")).alias("title"), C.ride_row_title(start, part, F.col("activity")).alias("row_title"))


def _nodes(spark, d):
    return read(spark, d, "customer").selectExpr("c_custkey AS node", "double((c_custkey * 7919) % 2003) AS x", "double((c_custkey * 104729) % 1999) AS y")


def nearest_junction(spark, d):
    """Parts as points among a graph of the customers."""
    e = read(spark, d, "customer").selectExpr("c_custkey AS a", "1 + (c_custkey * 31) % 997 AS b")
    p = read(spark, d, "part").selectExpr("p_partkey AS id", "(p_partkey * 337) % 2003 + 0.25D AS x", "(p_partkey * 733) % 1999 + 0.5D AS y")
    return R.junction_near(p, _nodes(spark, d), e, 120.0).select("id", "node", "degree", _round("distance", 6))


def street_names(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey AS k", "double((o_orderkey * 7919) % 6007) AS ax", "double((o_orderkey * 104729) % 5003) AS ay", "o_custkey AS c", "o_orderstatus AS s")
    w = o.selectExpr("ax", "ay", "ax + c % 90 - 40 AS bx", "ay + (k * 7) % 70 - 30 AS by", "IF(s = 'F', concat('Street ', c % 400), NULL) AS name", "CASE s WHEN 'F' THEN 'path' WHEN 'O' THEN 'track' END AS kind")
    p = read(spark, d, "part").selectExpr("p_partkey AS id", "(p_partkey * 2017) % 6007 + 0.3D AS x", "(p_partkey * 1009) % 5003 + 0.7D AS y", "double(p_partkey * 13 % 360) AS heading")
    return R.street_names(p, w)


def same_sections(spark, d):
    s = read(spark, d, "orders").selectExpr("o_orderkey AS k", "(o_orderkey * 7919) % 1009 / 2.0D AS x", "(o_orderkey * 104729) % 1013 / 2.0D AS y", "double(o_orderkey * 17 % 360) AS bearing", "40D + o_custkey % 60 AS meters", "o_orderkey % 3 AS activity")
    stored = s.where("k % 2 = 0").selectExpr("k AS record", "x", "y", "bearing", "meters", "activity", "k % 5 = 0 AS both_ways")
    return R.same_section(s.where("k % 2 = 1").withColumnRenamed("k", "id"), stored).select("id", "record", _round("distance", 6))


def roads_in_view(spark, d):
    o = read(spark, d, "orders")
    v = o.selectExpr("o_orderkey AS line_id", "CASE o_orderkey % 8 WHEN 0 THEN 'rail' WHEN 1 THEN 'pier' WHEN 2 THEN NULL ELSE 'minor' END AS class", "CASE o_orderkey % 11 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'ford' END AS brunnel", "o_orderkey % 97 AS a", "o_orderkey % 89 AS b")
    v = v.selectExpr("line_id", "class", "brunnel", "array(named_struct('lng', a / 8D, 'lat', b / 8D), named_struct('lng', a / 8D + 1, 'lat', b / 8D), named_struct('lng', a / 8D + 1.5D, 'lat', b / 8D + 2)) AS coords")
    return R.roads_in_view(v, 3.0, 2.0, 8.0, 7.0)


def compass_headings(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "IF(event_type = 'click', value * 7 - 300, NULL) AS compass", "IF(event_type <> 'error', value * 3, NULL) AS alpha", "event_type IN ('view', 'error') AS absolute")
    return R.compass_headings(e).select("event_id", _round("heading", 6))


def route_flags(spark, d):
    c = read(spark, d, "customer")
    r = c.selectExpr(
        "c_custkey AS route_id", "IF(c_custkey % 11 = 0, NULL, sequence(1, int(c_custkey % 4)  + 1)) AS waypoints", "IF(c_custkey % 7 = 0, array(), array(1)) AS legs", "IF(c_custkey % 13 = 0, NULL, array(0D)) AS coords",
        "IF(c_custkey % 3 = 0, array(), array(1)) AS places", "c_custkey % 17 = 0 AS destination", "IF(c_custkey % 5 = 0, 'gpx', NULL) AS source",
    )
    r = r.withColumn("waypoints", F.when(F.col("route_id") % 4 == 0, F.slice("waypoints", 1, 0)).otherwise(F.col("waypoints")))
    return R.route_flags(r).select("route_id", "valid", "can_follow", "is_empty")


def restored_rides(spark, d):
    o = ride(spark, d)
    c = o.selectExpr("id AS ride_id", "activity", "IF(id % 4 = 0, 'points', IF(id % 4 = 1, 'other', NULL)) AS route_mode", "IF(id % 3 = 0, NULL, id % 9) AS next_waypoint", "IF(id % 5 = 0, NULL, total_distance) AS total_distance", "IF(id % 6 = 0, NULL, moving_time_ms) AS moving_time_ms", "IF(id % 2 = 0, NULL, array(named_struct('start', start_ms, 'stop', start_ms + 1000))) AS pauses", "IF(id % 7 = 0, end_ms - 5000, NULL) AS pause_started_ms", "IF(id % 8 = 0, NULL, end_ms) AS last_fix_ms")
    out = R.restored(c, F.lit(900_000_000_000).cast("long"))
    return out.select("ride_id", "activity", "route_mode", "next_waypoint", F.round("total_distance", 4).alias("total_distance"), "moving_time_ms", F.size("pauses").alias("n_pauses"), F.try_element_at("pauses", F.lit(-1)).getField("start").alias("last_start"), "resumed_ms")


def spacing_pinned(spark, d):
    f = fix(spark, d)
    return R.with_pinned(P.reduce_rides(f, "spacing"), f, pause(f))


def box_exits(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey AS id", "double(o_orderkey % 400) AS x", "double(o_custkey % 300) AS y", "double(o_orderkey % 7 - 3) AS dx", "double(o_custkey % 5 - 2) AS dy")
    t = R.box_exit(F.col("x"), F.col("y"), F.col("dx"), F.col("dy"), 400.0, 300.0)
    return o.select("id", F.when(t < float("inf"), F.round(t + 1e-9, 6)).alias("t"))


def band_geojson(spark, d):
    return E.band_features(fix(spark, d), F.least(F.lit(15), F.floor(F.col("speed") * 4 / 5)).cast("int"))


def route_gpx_roundtrip(spark, d):
    """Tracks, marked stops and turn cues of rides as GPX text, read again: what stands there, cues left out."""
    f = fix(spark, d)
    pts = f.select(F.col("ride_id").alias("route_id"), "seq", "lat", "lng")
    marks = f.where("estimated").select(F.col("ride_id").alias("route_id"), F.col("seq").alias("i"), "lat", "lng", F.concat(F.lit("Stop <"), "seq", F.lit("> & more")).alias("name"), F.lit("Flag").alias("type"))
    cues = f.where("stopped").select(F.col("ride_id").alias("route_id"), F.col("seq").alias("i"), "lat", "lng", F.lit("Turn left").alias("name"), F.lit("Left").alias("type"))
    got = E.read_route_gpx(E.route_gpx(pts, marks.unionByName(cues)))
    return got.groupBy("route_id", "what").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("lat"), F.round(F.sum("lng"), 4).alias("lng"), F.min("name").alias("name"))


_FIX, _RIDE, _RUN = "WITH " + FIX_SQL, "WITH " + RIDE_SQL, "WITH " + STEP_SQL
_W = "PARTITION BY ride_id ORDER BY k"
_SLOPES = (
    _RUN + ", known AS (SELECT * FROM run WHERE altitude IS NOT NULL)" + _RS.format(src="known")
    + f", h AS (SELECT ride_id, k, altitude / 2 AS a, row_number() OVER w - 1 AS i, lead(altitude / 2) OVER w AS one, lead(altitude / 2, 2) OVER w AS two FROM rs WINDOW w AS ({_W})), p AS (SELECT ride_id, i // 2 AS j, i * 20 AS f, i * 20 + CASE WHEN two IS NULL THEN 20 ELSE 40 END AS t, (coalesce(two, one) - a) / CASE WHEN two IS NULL THEN 20 ELSE 40 END AS g FROM h WHERE i % 2 = 0 AND one IS NOT NULL)"
    # every start with every end up to which each piece keeps the sign, the longest of them; a start inside an earlier slope is none
    + ", c AS (SELECT unnest([false, true]) AS climbs_only), st AS (SELECT c.climbs_only, p.* FROM p, c WHERE CASE WHEN climbs_only THEN g ELSE abs(g) END >= 0.05::DOUBLE), en AS (SELECT s.climbs_only, s.ride_id, s.j, s.f, s.g, coalesce((SELECT min(q.j) FROM p q WHERE q.ride_id = s.ride_id AND q.j > s.j AND q.g * sign(s.g) < 0.02::DOUBLE), (SELECT max(q.j) + 1 FROM p q WHERE q.ride_id = s.ride_id)) - 1 AS e FROM st s)"
    + ", ok AS (SELECT * FROM en a WHERE NOT EXISTS (SELECT 1 FROM en b WHERE b.ride_id = a.ride_id AND b.climbs_only = a.climbs_only AND b.j < a.j AND b.e >= a.j)), m AS (SELECT ok.climbs_only, ok.ride_id, ok.f, max(p.t) AS t, sum(p.g * (p.t - p.f)) / sum(p.t - p.f) AS grade FROM ok JOIN p ON p.ride_id = ok.ride_id AND p.j BETWEEN ok.j AND ok.e GROUP BY ALL) SELECT ride_id, climbs_only, first(f ORDER BY f)::DOUBLE AS start, first(t ORDER BY f)::DOUBLE AS stop, round(first(grade ORDER BY f) + 1e-9, 6) AS grade FROM m WHERE f <= 400 AND t - f >= 80 AND abs(grade) >= 0.05::DOUBLE GROUP BY ALL"
)
_RAMP = "[[224, 90, 58], [224, 122, 58], [224, 166, 58], [201, 214, 58], [143, 201, 58], [47, 156, 79]]"


def _ramp_sql(t: str) -> str:
    at = f"(greatest(0, least(1, {t})) * 5)"
    i = f"(least(4, floor({at}))::INT + 1)"
    channel = lambda k: f"floor({_RAMP}[{i}][{k}] + ({_RAMP}[{i} + 1][{k}] - {_RAMP}[{i}][{k}]) * ({at} - ({i} - 1)) + 0.5)::INT"
    return f"'rgb(' || {channel(1)} || ', ' || {channel(2)} || ', ' || {channel(3)} || ')'"


_BEARING = "degrees(atan2(bx - ax, -(dy - ay)))"
QUERIES = {
    "slope_ahead": (slope_ahead, _SLOPES),
    "pace_colours": (pace_colours, _FIX + f"SELECT ride_id, seq, {_ramp_sql('(speed / 30 - 0.2::DOUBLE)')} AS pace, {_ramp_sql('((least(15, floor(greatest(0, least(1, speed / 40)) * 16)) + 0.5) / 16)')} AS band, CASE WHEN altitude IS NULL THEN NULL WHEN abs((altitude - 125) / 200) < 0.02::DOUBLE THEN '#2f9c4f' WHEN abs((altitude - 125) / 200) < 0.05::DOUBLE THEN '#a3c23a' WHEN abs((altitude - 125) / 200) < 0.08::DOUBLE THEN '#e0a63a' WHEN abs((altitude - 125) / 200) < 0.12::DOUBLE THEN '#e05a3a' ELSE '#8e2a5e' END AS grade FROM fix"),
    "ride_titles": (ride_titles, _RIDE + ", t AS (SELECT id, coalesce(nullif(activity, ''), 'bike') AS kind, date + to_seconds((id * 997) % 86400) AS s, moving_time_ms // 1000 AS n FROM ride), u AS (SELECT id, kind, s, s + to_seconds(n) AS e FROM t), v AS (SELECT *, CASE WHEN id % 50 = 0 THEN '' WHEN s::DATE <> e::DATE OR (hour(s) < 12 AND hour(e) >= 12) THEN 'All day' WHEN hour(s) < 12 THEN 'Morning' WHEN hour(s) < 17 THEN 'Afternoon' ELSE 'Evening' END AS part, CASE kind WHEN 'kayak' THEN 'paddle' WHEN 'bike' THEN 'ride' ELSE kind END AS noun FROM u), x AS (SELECT *, CASE WHEN part = '' THEN upper(noun[1]) || noun[2:] ELSE replace(part, 'All day', 'All-day') || ' ' || noun END AS title, CASE WHEN kind = 'bike' THEN part WHEN part = '' THEN upper(noun[1]) || noun[2:] ELSE replace(part, 'All day', 'All-day') || ' ' || noun END AS tail FROM v) SELECT id, title, strftime(s, '%b %-d') || CASE WHEN tail = '' THEN '' ELSE ' · ' || tail END AS row_title FROM x"),
    "nearest_junction": (nearest_junction, "WITH e AS (SELECT c_custkey AS a, 1 + (c_custkey * 31) % 997 AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), g AS (SELECT a AS node, count(DISTINCT b) AS degree FROM u GROUP BY a HAVING count(DISTINCT b) >= 3), n AS (SELECT node, degree, (node * 7919) % 2003 AS x, (node * 104729) % 1999 AS y FROM g WHERE node IN (SELECT c_custkey FROM customer)), p AS (SELECT p_partkey AS id, (p_partkey * 337) % 2003 + 0.25 AS x, (p_partkey * 733) % 1999 + 0.5 AS y FROM part), m AS (SELECT id, node, degree, sqrt(pow(n.x - p.x, 2) + pow(n.y - p.y, 2)) AS d FROM p, n) SELECT id, first(node ORDER BY d, node) AS node, first(degree ORDER BY d, node) AS degree, round(min(d) + 1e-9, 6) AS distance FROM m WHERE d <= 120 GROUP BY id"),
    "street_names": (street_names, "WITH o AS (SELECT o_orderkey AS k, ((o_orderkey * 7919) % 6007)::DOUBLE AS ax, ((o_orderkey * 104729) % 5003)::DOUBLE AS ay, o_custkey AS c, o_orderstatus AS s FROM orders), w AS (SELECT ax, ay, ax + c % 90 - 40 AS bx, ay + (k * 7) % 70 - 30 AS dy, CASE WHEN s = 'F' THEN 'Street ' || (c % 400) END AS name, CASE s WHEN 'F' THEN 'path' WHEN 'O' THEN 'track' END AS kind FROM o), p AS (SELECT p_partkey AS id, (p_partkey * 2017) % 6007 + 0.3::DOUBLE AS x, (p_partkey * 1009) % 5003 + 0.7::DOUBLE AS y, (p_partkey * 13 % 360)::DOUBLE AS heading FROM part), j AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (dy - ay)) / ((bx - ax) * (bx - ax) + (dy - ay) * (dy - ay)))) AS u, abs(((" + _BEARING + " - heading + 540) - 360 * floor((" + _BEARING + " - heading + 540) / 360)) - 180) AS off FROM p JOIN w ON (ax <> bx OR ay <> dy) AND x BETWEEN least(ax, bx) - 12 AND greatest(ax, bx) + 12 AND y BETWEEN least(ay, dy) - 12 AND greatest(ay, dy) + 12), m AS (SELECT *, sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (dy - ay), 2)) AS d FROM j WHERE least(off, 180 - off) <= 35) SELECT id, first(name ORDER BY d, name) FILTER (name IS NOT NULL) AS name, first(kind ORDER BY d, kind) FILTER (name IS NULL AND kind IS NOT NULL) AS kind FROM m WHERE d < 12 GROUP BY id"),
    "same_sections": (same_sections, "WITH s AS (SELECT o_orderkey AS k, (o_orderkey * 7919) % 1009 / 2 AS x, (o_orderkey * 104729) % 1013 / 2 AS y, o_orderkey * 17 % 360 AS h, 40 + o_custkey % 60 AS m, o_orderkey % 3 AS act FROM orders), j AS (SELECT f.k AS id, t.k AS record, sqrt(pow(t.x - f.x, 2) + pow(t.y - f.y, 2)) AS d, abs((t.h - f.h + 540) % 360 - 180) AS off, t.k % 5 = 0 AS both_ways, f.m AS fm, t.m AS tm FROM s f JOIN s t ON f.k % 2 = 1 AND t.k % 2 = 0 AND f.act = t.act AND abs(f.x - t.x) <= 10 AND abs(f.y - t.y) <= 10) SELECT id, first(record ORDER BY d, record) AS record, round(min(d) + 1e-9, 6) AS distance FROM j WHERE d <= least(10, 0.3::DOUBLE * fm) AND tm <= fm * 1.4::DOUBLE AND tm * 1.4::DOUBLE >= fm AND (off <= 45 OR (both_ways AND off >= 135)) GROUP BY id"),
    "roads_in_view": (roads_in_view, "WITH v AS (SELECT o_orderkey AS id, o_orderkey % 97 / 8 AS a, o_orderkey % 89 / 8 AS b FROM orders WHERE o_orderkey % 8 > 1 AND o_orderkey % 11 > 1) SELECT min(id) AS line_id FROM v WHERE (a BETWEEN 3 AND 8 AND b BETWEEN 2 AND 7) OR (a + 1 BETWEEN 3 AND 8 AND b BETWEEN 2 AND 7) OR (a + 1.5 BETWEEN 3 AND 8 AND b + 2 BETWEEN 2 AND 7) GROUP BY a, b"),
    "compass_headings": (compass_headings, "WITH h AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value * 7 - 300 WHEN event_type = 'view' THEN 360 - value * 3 END AS h FROM events) SELECT event_id, round(h - 360 * floor(h / 360) + 1e-9, 6) AS heading FROM h WHERE h IS NOT NULL"),
    "route_flags": (route_flags, "WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 4 + 1 END AS w FROM customer) SELECT id AS route_id, w IS NOT NULL AND id % 13 <> 0 AS valid, id % 17 = 0 OR (id % 5 <> 0 AND coalesce(w, 0) >= 2) AS can_follow, coalesce(w, 0) = 0 AND id % 7 = 0 AND id % 3 = 0 AS is_empty FROM r"),
    "restored_rides": (restored_rides, _RIDE + ", c AS (SELECT *, CASE WHEN id % 7 = 0 THEN end_ms - 5000 WHEN id % 8 <> 0 THEN end_ms END AS stood FROM ride) SELECT id AS ride_id, coalesce(activity, 'bike') AS activity, CASE WHEN id % 4 = 0 THEN 'points' ELSE 'asis' END AS route_mode, CASE WHEN id % 3 = 0 THEN 0 ELSE id % 9 END AS next_waypoint, round(CASE WHEN id % 5 = 0 THEN 0 ELSE total_distance END, 4) AS total_distance, CASE WHEN id % 6 = 0 THEN 0 ELSE moving_time_ms END AS moving_time_ms, ((id % 2 <> 0)::INT + coalesce((stood < 900000000000)::INT, 0))::INT AS n_pauses, CASE WHEN stood < 900000000000 THEN stood WHEN id % 2 <> 0 THEN start_ms END AS last_start, 900000000000 AS resumed_ms FROM c"),
    "spacing_pinned": (spacing_pinned, "WITH RECURSIVE " + FIX_SQL + _GREEDY.format(test="sqrt(pow(k.x - g.gx, 2) + pow(k.y - g.gy, 2)) >= 10").replace(") SELECT ride_id, seq FROM g WHERE keep OR seq = last", "), nx AS (SELECT ride_id, seq, t_ms, lead(t_ms) OVER (PARTITION BY ride_id ORDER BY seq) AS t2 FROM fix), pin AS (SELECT n.ride_id, n.seq FROM nx n JOIN pause p ON p.ride_id = n.ride_id AND least(p.stop, t2) - greatest(p.start, t_ms) > 0) SELECT ride_id, seq FROM g WHERE keep OR seq = last UNION SELECT * FROM pin UNION SELECT ride_id, seq + 1 FROM pin")),
    "box_exits": (box_exits, "WITH o AS (SELECT o_orderkey AS id, o_orderkey % 400 AS x, o_custkey % 300 AS y, o_orderkey % 7 - 3 AS dx, o_custkey % 5 - 2 AS dy FROM orders) SELECT id, round(least(CASE WHEN dx > 0 THEN (400 - x) / dx WHEN dx < 0 THEN -x / dx END, CASE WHEN dy > 0 THEN (300 - y) / dy WHEN dy < 0 THEN -y / dy END) + 1e-9, 6) AS t FROM o"),
    "band_geojson": (band_geojson, _FIX + ", b AS (SELECT *, least(15, floor(speed * 4 / 5))::INT AS band, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM fix WINDOW w AS (PARTITION BY ride_id ORDER BY seq)), e AS (SELECT *, band IS DISTINCT FROM lag(band) OVER (PARTITION BY ride_id ORDER BY seq) AS new FROM b WHERE plng IS NOT NULL), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY ride_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM e), l AS (SELECT ride_id, band, run, '[[' || first(plng ORDER BY seq) || ',' || first(plat ORDER BY seq) || ']' || string_agg(',[' || lng || ',' || lat || ']', '' ORDER BY seq) || ']' AS line FROM r GROUP BY ALL) SELECT ride_id, band, '{\"type\":\"Feature\",\"properties\":{\"band\":' || band || '},\"geometry\":{\"type\":\"MultiLineString\",\"coordinates\":[' || string_agg(line, ',' ORDER BY run) || ']}}' AS feature FROM l GROUP BY ride_id, band"),
    "route_gpx_roundtrip": (route_gpx_roundtrip, _FIX + ", x AS (SELECT ride_id AS route_id, 'track' AS what, lat, lng, NULL AS name FROM fix UNION ALL SELECT ride_id, 'place', lat, lng, 'Stop <' || seq || '> & more' FROM fix WHERE estimated) SELECT route_id, what, count(*) AS n, round(sum(round(lat, 6)), 4) AS lat, round(sum(round(lng, 6)), 4) AS lng, min(name) AS name FROM x GROUP BY ALL"),
}
