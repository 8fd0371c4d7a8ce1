"""Queries over position fixes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import angle_between, bearing, cell, flat_bearing, guidance_distance, mercator
from ..operators import tracks as T
from ..sources.lenses import FIX_SQL, RIDE_SQL, STEP_SQL, fix, pause  # noqa: F401


def _fix(spark: SparkSession, d: str) -> DataFrame:
    return fix(spark, d)


def _ran(spark: SparkSession, d: str) -> DataFrame:
    f = fix(spark, d)
    return T.running(T.moving(T.steps(f), pause(f)))


def r4(c: str, name: str | None = None) -> F.Column:
    return F.round(F.col(c), 4).alias(name or c)


def ride_totals(spark, d):
    f = fix(spark, d)
    t = T.totals(T.moving(T.steps(f), pause(f)))
    return t.select("ride_id", "n_fixes", r4("distance_m"), F.col("moving_ms").cast("long"), r4("max_speed"), r4("avg_speed"))


def fix_admission(spark, d):
    return T.admitted(_fix(spark, d)).groupBy("ride_id").agg(F.count("*").alias("n"), F.count("altitude").alias("n_altitude"), F.round(F.sum("speed"), 4).alias("speed_sum"))


def elevation_gain_drop(spark, d):
    return T.elevation_changes(_fix(spark, d)).select("ride_id", r4("gain"), r4("drop"))


def moving_time_running(spark, d):
    return _ran(spark, d).select("ride_id", "seq", r4("cum_m"), F.col("cum_ms").cast("long"))


def carry_forward_elevation(spark, d):
    return T.carried_elevation(_fix(spark, d)).select("ride_id", "seq", r4("elevation"))


def smooth_axis_range(spark, d):
    return T.smooth_by_axis(_ran(spark, d), "cum_m", "speed", "smooth", 100.0).select("ride_id", "seq", F.round(F.col("smooth") + 1e-9, 4).alias("smooth"))


def trailing_time_speed(spark, d):
    return T.trailing_speed(_ran(spark, d)).select("ride_id", "seq", r4("trailing_speed"))


def trailing_distance_pace(spark, d):
    return T.trailing_pace(_ran(spark, d)).select("ride_id", "seq", r4("trailing_pace"))


def splits_fixed_distance(spark, d):
    return T.splits(_ran(spark, d)).select("ride_id", F.col("segment").cast("long"), r4("distance_m"), F.col("duration_ms").cast("long"), "partial", r4("avg_speed"))


def split_markers(spark, d):
    return T.split_markers(_ran(spark, d)).select("ride_id", F.col("segment").cast("long"), "seq")


def speed_band_islands(spark, d):
    return T.band_runs(T.steps(_fix(spark, d))).select("ride_id", F.col("run").cast("long"), F.col("band").cast("long"), "first_seq", "last_seq", r4("length_m"))


def stable_start(spark, d):
    return T.stable_start(_fix(spark, d))


def gap_stretches(spark, d):
    s = T.stretches(T.steps(_fix(spark, d)))
    return s.groupBy("ride_id", F.col("stretch").cast("long").alias("stretch")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.round(F.sum(F.when(~T.gap(), F.col("step_m")).otherwise(0.0)), 4).alias("length_m"))


def bounding_boxes(spark, d):
    return T.bounding_box(_fix(spark, d)).select("ride_id", *[F.round(c, 6).alias(c) for c in ("south", "north", "west", "east")])


def accuracy_extremes(spark, d):
    return T.extremes(_fix(spark, d), "accuracy")


def neighbour_smoothing(spark, d):
    return T.neighbour_mean(_fix(spark, d), "altitude", "smooth").select("ride_id", "seq", r4("smooth"))


def slope_fit(spark, d):
    return T.slope(_fix(spark, d)).select("ride_id", "seq", F.round("slope", 6).alias("slope"))


def climb_descent(spark, d):
    return T.climb(_fix(spark, d)).select("ride_id", r4("climb"), r4("descent"))


def dead_reckon_fill(spark, d):
    return T.dead_reckoned(T.steps(_fix(spark, d))).select("ride_id", "seq", F.col("k").cast("long"), "t_ms", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def step_bearings(spark, d):
    s = T.steps(_fix(spark, d)).where("pt IS NOT NULL")
    b = bearing(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    f = flat_bearing(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    return s.select("ride_id", "seq", F.round(b, 3).alias("bearing"), F.round(angle_between(b, f), 2).alias("apart"))


def grid_cells(spark, d):
    x, y = mercator(F.col("lng"), F.col("lat"))
    a, b = cell(F.col("lat"), F.col("lng"), 50.0)
    c = _fix(spark, d).select("ride_id", a.alias("cell_lat"), b.alias("cell_lng"), F.floor(x / 4096).alias("tile_x"), F.floor(y / 4096).alias("tile_y"))
    return c.groupBy("cell_lat", "cell_lng", "tile_x", "tile_y").agg(F.count("*").alias("n"), F.countDistinct("ride_id").alias("n_rides"))


def first_last(spark, d):
    return _fix(spark, d).groupBy("ride_id").agg(F.min_by("t_ms", "seq").alias("first_ms"), F.max_by("t_ms", "seq").alias("last_ms"), F.count("*").alias("n"))


def guidance_text(spark, d):
    m = F.floor(F.col("cum_m") * 10) / 10 * (1 + F.col("seq") % 40)
    return _ran(spark, d).select("ride_id", "seq", guidance_distance(m).alias("text"), guidance_distance(m, imperial=True).alias("imperial"))


def running_max_speed(spark, d):
    return _fix(spark, d).select("ride_id", "seq", F.round(F.max("speed").over(T.upto()), 4).alias("furthest"))


def heading_changes(spark, d):
    """Fixes whose speed is unusable hold the last good heading."""
    s = T.steps(_fix(spark, d))
    own = F.when(F.col("speed") >= 0.894, bearing(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")))
    return s.withColumn("own", own).select("ride_id", "seq", F.round(F.last("own", ignorenulls=True).over(T.upto()), 3).alias("heading"))


_RUN = "WITH " + STEP_SQL
_FIX = "WITH " + FIX_SQL
_W = "PARTITION BY ride_id ORDER BY seq"
_CROSS = ", cross0 AS (SELECT *, floor(cum_m / 100)::BIGINT AS n FROM run), cross1 AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY ride_id ORDER BY seq), 0) AS before FROM cross0)"
_BEARING = "(degrees(atan2(sin(radians(lng - plng)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lng - plng)))) + 360)"

QUERIES = {
    "ride_totals": (ride_totals, _RUN + "SELECT ride_id, count(*) AS n_fixes, round(sum(step_m), 4) AS distance_m, sum(step_ms)::BIGINT AS moving_ms, round(greatest(0, max(speed)), 4) AS max_speed, round(CASE WHEN sum(step_ms) = 0 THEN 0 ELSE sum(step_m) / (sum(step_ms) / 1000) END, 4) AS avg_speed FROM step GROUP BY ride_id"),
    "fix_admission": (fix_admission, _FIX + "SELECT ride_id, count(*) AS n, count(altitude) AS n_altitude, round(sum(greatest(speed, 0)), 4) AS speed_sum FROM fix WHERE seq = 0 OR accuracy <= 20 GROUP BY ride_id"),
    "elevation_gain_drop": (elevation_gain_drop, _FIX + f", s AS (SELECT ride_id, seq, avg(altitude) OVER ({_W} ROWS 4 PRECEDING) AS a FROM fix WHERE altitude IS NOT NULL), t AS (SELECT ride_id, coalesce(a - lag(a) OVER ({_W}), 0) AS x FROM s) SELECT ride_id, round(sum(greatest(x, 0)), 4) AS gain, round(sum(greatest(-x, 0)), 4) AS drop FROM t GROUP BY ride_id"),
    "moving_time_running": (moving_time_running, _RUN + "SELECT ride_id, seq, round(cum_m, 4) AS cum_m, cum_ms::BIGINT AS cum_ms FROM run"),
    "carry_forward_elevation": (carry_forward_elevation, _FIX + f"SELECT ride_id, seq, round(coalesce(last_value(altitude IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0), 4) AS elevation FROM fix"),
    "smooth_axis_range": (smooth_axis_range, _RUN + ", x AS (SELECT ride_id, seq, speed, cum_m / greatest(100, max(cum_m) OVER (PARTITION BY ride_id) / 80) AS x FROM run) SELECT ride_id, seq, round(avg(speed) OVER (PARTITION BY ride_id ORDER BY x RANGE BETWEEN 0.5::DOUBLE PRECEDING AND 0.5::DOUBLE FOLLOWING) + 1e-9, 4) AS smooth FROM x"),
    "trailing_time_speed": (trailing_time_speed, _RUN + ", a AS (SELECT *, least(min(seq) OVER (PARTITION BY ride_id ORDER BY t_ms RANGE BETWEEN 6000 PRECEDING AND CURRENT ROW), seq - 1) AS f FROM run) SELECT a.ride_id, a.seq, round(coalesce(CASE WHEN a.t_ms > b.t_ms THEN (a.cum_m - b.cum_m) / ((a.t_ms - b.t_ms) / 1000) END, 0), 4) AS trailing_speed FROM a LEFT JOIN run b ON b.ride_id = a.ride_id AND b.seq = a.f"),
    "trailing_distance_pace": (trailing_distance_pace, _RUN + f", g AS (SELECT *, sum(coalesce((t_ms - pt > 10000 OR step_m > 60)::INT, 0)) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS stretch FROM run), f AS (SELECT a.ride_id, a.seq, a.cum_m, a.t_ms, coalesce(max(CASE WHEN b.cum_m <= a.cum_m - 150 THEN b.seq END), min(b.seq)) AS k FROM g a JOIN g b ON a.ride_id = b.ride_id AND a.stretch = b.stretch GROUP BY ALL) SELECT f.ride_id, f.seq, round(CASE WHEN f.cum_m - r.cum_m >= 40 AND f.t_ms > r.t_ms THEN (f.cum_m - r.cum_m) / ((f.t_ms - r.t_ms) / 1000) END, 4) AS trailing_pace FROM f JOIN run r ON r.ride_id = f.ride_id AND r.seq = f.k"),
    "splits_fixed_distance": (splits_fixed_distance, _RUN + _CROSS + ", seg AS (SELECT ride_id, unnest(range(before + 1, n + 1)) AS segment, cum_ms AS at_ms FROM cross1 WHERE n > before), s AS (SELECT ride_id, segment, 100::DOUBLE AS distance_m, at_ms - coalesce(lag(at_ms) OVER (PARTITION BY ride_id ORDER BY segment), 0) AS duration_ms, false AS partial FROM seg UNION ALL SELECT ride_id, max(n) + 1, max(cum_m) - max(n) * 100, max(cum_ms) - coalesce(max(CASE WHEN n > before THEN cum_ms END), 0), true FROM cross1 GROUP BY ride_id HAVING max(cum_m) - max(n) * 100 > 1) SELECT ride_id, segment, round(distance_m, 4) AS distance_m, duration_ms::BIGINT AS duration_ms, partial, round(CASE WHEN duration_ms = 0 THEN 0 ELSE distance_m / (duration_ms / 1000) END, 4) AS avg_speed FROM s"),
    "split_markers": (split_markers, _RUN + _CROSS + ", seg AS (SELECT ride_id, seq AS at, unnest(range(before + 1, n + 1)) AS segment FROM cross1 WHERE n > before), k AS (SELECT s.ride_id, s.segment, r.seq, row_number() OVER (PARTITION BY s.ride_id, s.segment ORDER BY abs(r.cum_m - s.segment * 100), (r.seq <> s.at - 1)::INT, r.seq) AS k FROM seg s JOIN run r ON r.ride_id = s.ride_id AND r.seq BETWEEN greatest(0, s.at - 5) AND s.at - 1) SELECT ride_id, segment, seq FROM k WHERE k = 1"),
    "speed_band_islands": (speed_band_islands, _RUN + f", b AS (SELECT *, max(speed) OVER (PARTITION BY ride_id) AS top FROM step1), c AS (SELECT *, least(15, floor(greatest(0, least(1, CASE WHEN top = 0 THEN 0 ELSE (speed + pspeed) / 2 / top END)) * 16))::BIGINT AS band FROM b WHERE pt IS NOT NULL), e AS (SELECT *, coalesce((band <> lag(band) OVER ({_W}))::INT, 0) AS new FROM c), r AS (SELECT *, sum(new) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e) SELECT ride_id, run, band, min(seq) AS first_seq, max(seq) AS last_seq, round(sum(step_m), 4) AS length_m FROM r GROUP BY ALL"),
    "stable_start": (stable_start, _FIX + f", b AS (SELECT *, coalesce(accuracy <= 2 * min(accuracy) OVER (PARTITION BY ride_id), false)::INT AS ok, count(accuracy) OVER (PARTITION BY ride_id) AS known FROM fix), c AS (SELECT *, min(ok) OVER w AS a, count(*) OVER w AS n FROM b WINDOW w AS ({_W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) SELECT ride_id, coalesce(min(CASE WHEN a = 1 AND n = 3 AND known >= 3 THEN seq END), 0) AS start_seq FROM c GROUP BY ride_id"),
    "gap_stretches": (gap_stretches, _RUN + f", g AS (SELECT *, coalesce(t_ms - pt > 10000 OR step_m > 60, false) AS gap FROM step1), h AS (SELECT *, sum(gap::INT) OVER ({_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS stretch FROM g) SELECT ride_id, stretch, count(*) AS n, min(seq) AS first_seq, round(sum(CASE WHEN NOT gap THEN step_m ELSE 0 END), 4) AS length_m FROM h GROUP BY ALL"),
    "bounding_boxes": (bounding_boxes, _FIX + "SELECT ride_id, round(min(lat) - (max(lat) - min(lat)) * 0.12::DOUBLE, 6) AS south, round(max(lat) + (max(lat) - min(lat)) * 0.12::DOUBLE, 6) AS north, round(min(lng) - (max(lng) - min(lng)) * 0.12::DOUBLE, 6) AS west, round(max(lng) + (max(lng) - min(lng)) * 0.12::DOUBLE, 6) AS east FROM fix GROUP BY ride_id"),
    "accuracy_extremes": (accuracy_extremes, _FIX + "SELECT ride_id, arg_min(seq, accuracy * 1e6 + seq) AS least_seq, arg_max(seq, accuracy * 1e6 - seq) AS most_seq FROM fix GROUP BY ride_id"),
    "neighbour_smoothing": (neighbour_smoothing, _FIX + f"SELECT ride_id, seq, round(avg(altitude) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM fix"),
    "slope_fit": (slope_fit, _FIX + f"SELECT ride_id, seq, round(CASE WHEN count(altitude) OVER w = 11 THEN regr_slope(altitude, seq * 10::DOUBLE) OVER w END, 6) AS slope FROM fix WINDOW w AS ({_W} ROWS 10 PRECEDING)"),
    "climb_descent": (climb_descent, "WITH RECURSIVE " + FIX_SQL + ", k AS (SELECT ride_id, altitude AS h, row_number() OVER (PARTITION BY ride_id ORDER BY seq) AS i FROM fix WHERE altitude IS NOT NULL), f AS (SELECT ride_id, i, h AS anchor, 0::DOUBLE AS up, 0::DOUBLE AS down FROM k WHERE i = 1 UNION ALL SELECT k.ride_id, k.i, CASE WHEN abs(h - anchor) >= 3 THEN h ELSE anchor END, up + CASE WHEN h - anchor >= 3 THEN h - anchor ELSE 0 END, down + CASE WHEN anchor - h >= 3 THEN anchor - h ELSE 0 END FROM f JOIN k ON k.ride_id = f.ride_id AND k.i = f.i + 1) SELECT ride_id, round(max(up), 4) AS climb, round(max(down), 4) AS descent FROM f GROUP BY ride_id HAVING max(i) >= 2"),
    "dead_reckon_fill": (dead_reckon_fill, _RUN + f", s AS (SELECT *, lead(t_ms) OVER ({_W}) AS nt FROM step1), e AS (SELECT *, unnest(range(1, greatest(1, least(40, floor((nt - t_ms - 1) / 250)))::BIGINT + 1)) AS k FROM s WHERE nt - t_ms > 3500 AND plat IS NOT NULL AND step_m > 0) SELECT ride_id, seq, k, t_ms + k * 250 AS t_ms, round(lat + (lat - plat) * (speed * k * 250 / 1000 / step_m), 6) AS lat, round(lng + (lng - plng) * (speed * k * 250 / 1000 / step_m), 6) AS lng FROM e"),
    "step_bearings": (step_bearings, _RUN + f", b AS (SELECT ride_id, seq, {_BEARING} - 360 * floor({_BEARING} / 360) AS b, degrees(atan2((lng - plng) * 111320 * cos(radians((plat + lat) / 2)), (lat - plat) * 110574)) AS f FROM step1 WHERE pt IS NOT NULL) SELECT ride_id, seq, round(b, 3) AS bearing, round(least(abs(b - f) % 360, 360 - abs(b - f) % 360), 2) AS apart FROM b"),
    "grid_cells": (grid_cells, _FIX + "SELECT floor(lat * 110574 / 50)::BIGINT AS cell_lat, floor(lng * 111320 * cos(radians(lat)) / 50)::BIGINT AS cell_lng, floor((lng + 180) / 360 * 67108864 / 4096)::BIGINT AS tile_x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 67108864 / 4096)::BIGINT AS tile_y, count(*) AS n, count(DISTINCT ride_id) AS n_rides FROM fix GROUP BY 1, 2, 3, 4"),
    "first_last": (first_last, _FIX + "SELECT ride_id, arg_min(t_ms, seq) AS first_ms, arg_max(t_ms, seq) AS last_ms, count(*) AS n FROM fix GROUP BY ride_id"),
    "guidance_text": (guidance_text, _RUN + ", m AS (SELECT ride_id, seq, floor(cum_m * 10) / 10 * (1 + seq % 40) AS m FROM run), f AS (SELECT *, m * 3.28084::DOUBLE AS ft, m / 1609.344::DOUBLE AS mi, m / 1000 AS km FROM m), n AS (SELECT *, (floor(ft / CASE WHEN ft < 100 THEN 10 ELSE 50 END + 0.5) * CASE WHEN ft < 100 THEN 10 ELSE 50 END)::BIGINT AS rf, (floor(m / CASE WHEN m < 200 THEN 10 ELSE 50 END + 0.5) * CASE WHEN m < 200 THEN 10 ELSE 50 END)::BIGINT AS rm FROM f) SELECT ride_id, seq, CASE WHEN rm < 1000 THEN rm || ' m' WHEN km < 10 THEN printf('%.1f', km + CASE WHEN km * 20 = floor(km * 20) AND (km * 20) % 2 = 1 AND km * 4 = floor(km * 4) THEN 0.01 ELSE 0 END) || ' km' ELSE floor(km + 0.5)::BIGINT || ' km' END AS text, CASE WHEN rf < 1000 THEN rf || ' ft' WHEN mi < 10 THEN printf('%.1f', mi) || ' mi' ELSE floor(mi + 0.5)::BIGINT || ' mi' END AS imperial FROM n"),
    "running_max_speed": (running_max_speed, _FIX + f"SELECT ride_id, seq, round(max(speed) OVER ({_W} ROWS UNBOUNDED PRECEDING), 4) AS furthest FROM fix"),
    "heading_changes": (heading_changes, _RUN + f", b AS (SELECT ride_id, seq, CASE WHEN speed >= 0.894 THEN {_BEARING} - 360 * floor({_BEARING} / 360) END AS own FROM step1) SELECT ride_id, seq, round(last_value(own IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING), 3) AS heading FROM b"),
}
