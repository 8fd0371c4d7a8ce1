"""Queries along lines, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines as L
from ..operators import tracks as T
from ..sources.lenses import FIX_SQL, STEP_SQL, fix, pause, read


def _ran(spark, d):
    f = fix(spark, d)
    return T.running(T.moving(T.steps(f), pause(f)))


def r(c: str, n: int = 4) -> F.Column:
    return F.round(F.col(c) + 1e-9, n).alias(c)


def resample_line(spark, d):
    return L.resampled(_ran(spark, d)).select("ride_id", "k", r("lat", 6), r("lng", 6), r("altitude", 3))


def value_at_distance(spark, d):
    ran = _ran(spark, d)
    asked = ran.select("ride_id", F.col("seq").alias("id"), (F.col("cum_m") + 3.5).alias("d"))
    return L.value_along(ran, asked, "t_ms").select("ride_id", "id", F.round("value", 2).alias("value"))


def nearest_on_chart(spark, d):
    return L.nearest_on_axis(_ran(spark, d), "cum_m", F.lit(333.3))


def span_mean_speed(spark, d):
    return L.span_means(fix(spark, d)).select("ride_id", "block", r("mean_speed"))


def kept_half_windows(spark, d):
    return L.half_windows(fix(spark, d).where("seq % 4 = 0 OR stopped").select("ride_id", "seq"))


def _route_points(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("route_id"), F.col("l_partkey").alias("i")).agg(F.min("l_linestatus").alias("s"), F.min("l_returnflag").alias("t"), F.min("l_discount").alias("u")).selectExpr("route_id", "i", "IF(s = 'O', NULL, t = 'A') AS stop", "IF(t = 'R', 'flag', NULL) AS icon", "IF(u > 0.05D, 'x', NULL) AS title")


def stop_numbers(spark, d):
    return L.stops(_route_points(spark, d)).select("route_id", "i", "is_stop", F.col("number").cast("long"))


def mark_normalisation(spark, d):
    p = read(spark, d, "part").selectExpr("p_partkey AS id", "p_brand AS icon", "IF(p_size % 3 = 0, '  ', concat('  ', p_name, ' ', p_type, ' ', p_name)) AS title")
    return L.normalized_marks(p, ("Brand#1", "Brand#11", "Brand#12", "Brand#3"))


def grade_hysteresis(spark, d):
    s = fix(spark, d).withColumn("grade", (F.col("altitude") - 125) / 1000)
    return L.shown_with_hysteresis(s, "grade", 0.02, 0.01).select("ride_id", "seq", "shown")


def climb_pieces(spark, d):
    s = L.resampled(_ran(spark, d).where("altitude IS NOT NULL"))
    return L.sign_pieces(s).select("ride_id", F.col("run").cast("long"), "k", "meters", r("slope", 5))


def turn_kinds(spark, d):
    s = fix(spark, d).select("ride_id", F.col("seq").alias("k"), "lat", (F.col("lng") * 1.0).alias("lng"))
    return L.turns(s).groupBy("kind", "side").agg(F.count("*").alias("n"))


def open_stretches(spark, d):
    return L.open_stretches(T.steps(fix(spark, d))).select("ride_id", F.col("stretch").cast("long"), "first_seq", "last_seq", r("meters"))


def tile_neighbourhood(spark, d):
    return L.ridden_tiles(fix(spark, d))


def corridor_tiles(spark, d):
    t = spark.range(0, 3600).selectExpr("id % 60 AS x", "id div 60 AS y")
    return L.corridor_tiles(t, 3.0, 5.0, 50.0, 41.0, 4.0).select("x", "y", r("distance"))


def tile_catalog(spark, d):
    u = read(spark, d, "pages").selectExpr("concat('https://tiles', page_id % 3, '.example/v', page_id % 2, '/14/', page_id % 20, '/', page_id % 15, '.mvt') AS url")
    return L.tile_catalog(u, ("tiles0.example", "tiles1.example"))


def pace_trend(spark, d):
    p = T.trailing_pace(_ran(spark, d)).withColumn("own", F.avg("speed").over(T.whole()))
    return L.pace_trend(p, F.round("own", 6)).groupBy("ride_id", "trend").agg(F.count("*").alias("n"))


def waypoint_arrivals(spark, d):
    ran = _ran(spark, d)
    pts = ran.groupBy("ride_id").agg(F.max("cum_m").alias("m")).select("ride_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"), "m").withColumn("at", F.col("m") * F.col("i") / 4)
    return L.reached_points(ran, pts.drop("m")).select("ride_id", F.col("i").cast("long"), "seq")


def eta(spark, d):
    t = _ran(spark, d)
    kind = F.when(F.col("ride_id") % 3 == 0, "bike").when(F.col("ride_id") % 3 == 1, "kayak").otherwise("walk")
    return t.select("ride_id", "seq", F.round(L.eta_seconds(F.lit(1500.0), F.col("cum_ms"), F.col("cum_m"), kind), 2).alias("eta"), F.round(L.band_opacity(F.col("cum_m")), 4).alias("opacity"))


def language_tags(spark, d):
    return read(spark, d, "nation").select("n_nationkey", L.language_tag(F.concat(F.substring("n_name", 1, 2), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("_"), F.substring("n_name", 3, 2))).otherwise(""))).alias("tag"))


def missing_tiles(spark, d):
    """Wanted less present: an anti-join."""
    have = tile_catalog(spark, d).select("x", "y")
    want = spark.range(0, 400).selectExpr("id % 20 AS x", "id div 20 AS y")
    return want.join(have, ["x", "y"], "left_anti")


_RUN, _FIX = "WITH " + STEP_SQL, "WITH " + FIX_SQL
_W = "PARTITION BY ride_id ORDER BY seq"
_RS = f", nx AS (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, lead(altitude) OVER w AS v2, lead(cum_m) OVER w AS m2 FROM {{src}} WINDOW w AS ({_W})), ks AS (SELECT *, unnest(range(ceil(cum_m / 20)::BIGINT, ceil(m2 / 20)::BIGINT)) AS k FROM nx WHERE m2 > cum_m), rs AS (SELECT ride_id, k, lat + (lat2 - lat) * ((k * 20 - cum_m) / (m2 - cum_m)) AS lat, lng + (lng2 - lng) * ((k * 20 - cum_m) / (m2 - cum_m)) AS lng, altitude + (v2 - altitude) * ((k * 20 - cum_m) / (m2 - cum_m)) AS altitude FROM ks)"
_CAT = "c AS (SELECT DISTINCT page_id % 20 AS x, page_id % 15 AS y, 'https://tiles' || (page_id % 3) || '.example/v' || (page_id % 2) || '/14/' || (page_id % 20) || '/' || (page_id % 15) || '.mvt' AS url FROM pages WHERE page_id % 3 < 2)"

QUERIES = {
    "resample_line": (resample_line, _RUN + _RS.format(src="run") + "SELECT ride_id, k, round(lat + 1e-9, 6) AS lat, round(lng + 1e-9, 6) AS lng, round(altitude + 1e-9, 3) AS altitude FROM rs"),
    "value_at_distance": (value_at_distance, _RUN + ", q AS (SELECT ride_id, seq AS id, cum_m + 3.5 AS d FROM run), ab AS (SELECT q.ride_id, q.id, q.d, max(CASE WHEN r.cum_m <= q.d THEN r.seq END) AS a, min(CASE WHEN r.cum_m > q.d THEN r.seq END) AS b FROM q JOIN run r USING (ride_id) GROUP BY ALL) SELECT ab.ride_id, ab.id, round(CASE WHEN y.t_ms IS NULL THEN x.t_ms ELSE x.t_ms + (y.t_ms - x.t_ms) * ((d - x.cum_m) / (y.cum_m - x.cum_m)) END, 2) AS value FROM ab JOIN run x ON x.ride_id = ab.ride_id AND x.seq = ab.a LEFT JOIN run y ON y.ride_id = ab.ride_id AND y.seq = ab.b"),
    "nearest_on_chart": (nearest_on_chart, _RUN + "SELECT ride_id, first(seq ORDER BY round(abs(cum_m - 333.3::DOUBLE), 6), seq) AS seq FROM run GROUP BY ride_id"),
    "span_mean_speed": (span_mean_speed, _FIX + f", s AS (SELECT ride_id, (seq - 1) // 10 AS block, t_ms - lag(t_ms) OVER w AS dt, (speed + lag(speed) OVER w) / 2 AS m FROM fix WINDOW w AS ({_W})) SELECT ride_id, block, round(CASE WHEN sum(dt) > 0 THEN sum(m * dt) / sum(dt) ELSE avg(m) END + 1e-9, 4) AS mean_speed FROM s WHERE dt IS NOT NULL GROUP BY ALL"),
    "kept_half_windows": (kept_half_windows, _FIX + f", k AS (SELECT ride_id, seq FROM fix WHERE seq % 4 = 0 OR stopped) SELECT ride_id, seq, (coalesce(lag(seq) OVER w, seq) + seq) // 2 AS lo, (seq + coalesce(lead(seq) OVER w, seq)) // 2 AS hi FROM k WINDOW w AS ({_W})"),
    "stop_numbers": (stop_numbers, "WITH g AS (SELECT l_suppkey AS route_id, l_partkey AS i, min(l_linestatus) AS s, min(l_returnflag) AS t, min(l_discount) AS u FROM lineitem GROUP BY ALL), e AS (SELECT *, lag(i) OVER w IS NULL OR lead(i) OVER w IS NULL AS edge FROM g WINDOW w AS (PARTITION BY route_id ORDER BY i)), f AS (SELECT route_id, i, CASE WHEN edge THEN true ELSE coalesce(CASE WHEN s = 'O' THEN NULL ELSE t = 'A' END, t = 'R' OR u > 0.05::DOUBLE) END AS is_stop FROM e) SELECT route_id, i, is_stop, CASE WHEN is_stop THEN (sum(is_stop::INT) OVER (PARTITION BY route_id ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT END AS number FROM f"),
    "mark_normalisation": (mark_normalisation, "WITH m AS (SELECT p_partkey AS id, CASE WHEN p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#3') THEN p_brand END AS icon, CASE WHEN p_size % 3 <> 0 THEN left(trim(p_name || ' ' || p_type || ' ' || p_name), 40) END AS title FROM part) SELECT * FROM m WHERE icon IS NOT NULL OR title IS NOT NULL"),
    "grade_hysteresis": (grade_hysteresis, _FIX + f", g AS (SELECT ride_id, seq, CASE WHEN abs((altitude - 125) / 1000) >= 0.02::DOUBLE THEN true WHEN abs((altitude - 125) / 1000) < 0.01::DOUBLE THEN false END AS d FROM fix) SELECT ride_id, seq, coalesce(last_value(d IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), false) AS shown FROM g"),
    "climb_pieces": (climb_pieces, _RUN + ", known AS (SELECT * FROM run WHERE altitude IS NOT NULL)" + _RS.format(src="known") + ", s AS (SELECT ride_id, k, (lead(altitude) OVER (PARTITION BY ride_id ORDER BY k) - altitude) / 20 AS slope FROM rs), t AS (SELECT *, coalesce((sign(slope) <> lag(sign(slope)) OVER (PARTITION BY ride_id ORDER BY k))::INT, 0) AS new FROM s WHERE slope IS NOT NULL), u AS (SELECT *, sum(new) OVER (PARTITION BY ride_id ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM t) SELECT ride_id, run, min(k) AS k, count(*) * 20::DOUBLE AS meters, round(avg(slope) + 1e-9, 5) AS slope FROM u GROUP BY ALL"),
    "turn_kinds": (turn_kinds, _FIX + f", h AS (SELECT ride_id, seq, degrees(atan2((lead(lng) OVER w - lng) * 111320 * cos(radians((lat + lead(lat) OVER w) / 2)), (lead(lat) OVER w - lat) * 110574)) AS h FROM fix WINDOW w AS ({_W})), c AS (SELECT h - lag(h) OVER ({_W}) AS c FROM h), n AS (SELECT c + 540 - 360 * floor((c + 540) / 360) - 180 AS c FROM c) SELECT CASE WHEN abs(c) >= 165 THEN 'uturn' WHEN abs(c) >= 135 THEN 'sharp' WHEN abs(c) >= 60 THEN 'plain' ELSE 'slight' END AS kind, CASE WHEN abs(c) >= 165 THEN '' WHEN c < 0 THEN 'left' ELSE 'right' END AS side, count(*) AS n FROM n WHERE abs(c) >= 30 GROUP BY 1, 2"),
    "open_stretches": (open_stretches, _RUN + f", b AS (SELECT *, pt IS NULL OR estimated OR t_ms <= pt OR t_ms - pt > 300000 AS broken FROM step1), s AS (SELECT *, sum(broken::INT) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM b) SELECT ride_id, stretch, min(seq) AS first_seq, max(seq) AS last_seq, round(sum(CASE WHEN broken THEN 0 ELSE step_m END) + 1e-9, 4) AS meters FROM s GROUP BY ALL HAVING sum(CASE WHEN broken THEN 0 ELSE step_m END) >= 75"),
    "tile_neighbourhood": (tile_neighbourhood, _FIX + ", t AS (SELECT DISTINCT floor((lng + 180) / 360 * 67108864 / 4096)::BIGINT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 67108864 / 4096)::BIGINT AS y FROM fix) SELECT DISTINCT x + i - 1 AS x, y + j - 1 AS y FROM t, range(3) a(i), range(3) b(j)"),
    "corridor_tiles": (corridor_tiles, "WITH t AS (SELECT i % 60 AS x, i // 60 AS y FROM range(3600) r(i)), u AS (SELECT *, greatest(0, least(1, ((x + 0.5 - 3) * 47 + (y + 0.5 - 5) * 36) / (47 * 47 + 36 * 36)::DOUBLE)) AS u FROM t), d AS (SELECT x, y, sqrt(pow(x + 0.5 - 3 - u * 47, 2) + pow(y + 0.5 - 5 - u * 36, 2)) AS d FROM u) SELECT x, y, round(d + 1e-9, 4) AS distance FROM d WHERE d <= 4 ORDER BY round(d, 6), x, y LIMIT 200"),
    "tile_catalog": (tile_catalog, "WITH " + _CAT + " SELECT 14::BIGINT AS z, x, y, max(url) AS url FROM c GROUP BY x, y"),
    "pace_trend": (pace_trend, _RUN + f", g AS (SELECT *, sum(coalesce((t_ms - pt > 10000 OR step_m > 60)::INT, 0)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS stretch, round(avg(speed) OVER (PARTITION BY ride_id), 6) AS own FROM run), f AS (SELECT a.ride_id, a.seq, a.cum_m, a.t_ms, a.own, coalesce(max(CASE WHEN b.cum_m <= a.cum_m - 150 THEN b.seq END), min(b.seq)) AS k FROM g a JOIN g b ON a.ride_id = b.ride_id AND a.stretch = b.stretch GROUP BY ALL), t AS (SELECT f.ride_id, own, CASE WHEN f.cum_m - r.cum_m >= 40 AND f.t_ms > r.t_ms THEN (f.cum_m - r.cum_m) / ((f.t_ms - r.t_ms) / 1000) END AS p FROM f JOIN run r ON r.ride_id = f.ride_id AND r.seq = f.k) SELECT ride_id, CASE WHEN p IS NULL OR own IS NULL THEN 'none' WHEN abs(p - own) <= 0.2235::DOUBLE THEN 'even' WHEN p > own THEN 'ahead' ELSE 'behind' END AS trend, count(*) AS n FROM t GROUP BY 1, 2"),
    "waypoint_arrivals": (waypoint_arrivals, _RUN + ", p AS (SELECT ride_id, i, max(cum_m) * i / 4 AS a FROM run, range(1, 5) t(i) GROUP BY ride_id, i), m AS (SELECT p.ride_id, i, min(seq) AS f FROM p JOIN run r ON r.ride_id = p.ride_id AND abs(cum_m - a) <= 30 GROUP BY ALL) SELECT ride_id, i, max(f) OVER (PARTITION BY ride_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS seq FROM m"),
    "eta": (eta, _RUN + ", o AS (SELECT *, CASE WHEN cum_ms = 0 THEN 0 ELSE cum_m / (cum_ms / 1000) END AS own, greatest(0, 1 - pow(cum_m / 500, 1.4::DOUBLE)) * 0.6::DOUBLE AS op FROM run) SELECT ride_id, seq, round(1500 / CASE WHEN cum_ms > 60000 AND own > 1 THEN own WHEN ride_id % 3 = 0 THEN 4.5::DOUBLE WHEN ride_id % 3 = 1 THEN 1.5::DOUBLE ELSE 1.3::DOUBLE END, 2) AS eta, round(CASE WHEN op > 0.01 THEN op END, 4) AS opacity FROM o"),
    "language_tags": (language_tags, "SELECT n_nationkey, lower(left(n_name, 2)) || CASE WHEN n_nationkey % 2 = 0 THEN '-' || upper(substr(n_name, 3, 2)) ELSE '' END AS tag FROM nation"),
    "missing_tiles": (missing_tiles, "WITH " + _CAT + " SELECT i % 20 AS x, i // 20 AS y FROM range(400) t(i) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.x = i % 20 AND c.y = i // 20)"),
}
