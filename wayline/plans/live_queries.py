"""Queries over live rides and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.lenses import TRACK_SQL, hav_sql, recording, track
from ..sources.shared import shared_dir
from ..streaming import late, recorder

RULES = recorder.Rules(split_m=100.0)


def _log(rows):
    """Outages and closings depend on how far time has come; the rest of the log does not. Halves are told by the
    product, as in the SQL's round."""
    out = rows.where("kind IN ('fix', 'estimated', 'split')")
    cut = lambda c, n: (F.round(F.col(c) * 10.0**n) / 10.0**n).alias(c)
    return out.select("ride_id", "kind", "seq", "k", "t_ms", cut("lat", 6), cut("lng", 6), cut("distance_m", 3), "elapsed_ms", cut("heading", 3), cut("max_speed", 4), cut("gain", 4), cut("drop", 4))


def recorded_log(spark, d):
    """Finished rides, folded."""
    return _log(recorder.recorded(recording(track(spark, d)), RULES))


def live_log(spark, d):
    """The same rides as they come in, in three runs from a checkpoint."""
    rows = recording(track(spark, d))
    lo, hi = rows.agg(F.min("t_ms"), F.max("t_ms")).first()
    cuts = [] if lo is None else [lo + (hi - lo) * k // 3 for k in (1, 2)]
    return _log(recorder.replay(rows, f"{shared_dir(spark)}/recorder-{uuid.uuid4().hex}", cuts, RULES))


_DRIFT = "list_reduce(list_transform(range(1, {n} + 1), lambda i: {{'lat': 0::DOUBLE, 'lng': 0::DOUBLE, 'm': 0::DOUBLE, 'k': i}}), lambda a, b: {{'lat': a.lat + {v} * cos(radians({h})) / 111320, 'lng': a.lng + {v} * sin(radians({h})) / (111320 * cos(radians(a.lat))), 'm': a.m + " + hav_sql("a.lat", "a.lng", "(a.lat + {v} * cos(radians({h})) / 111320)", "(a.lng + {v} * sin(radians({h})) / (111320 * cos(radians(a.lat))))") + ", 'k': b.k}}, {{'lat': {lat}, 'lng': {lng}, 'm': 0::DOUBLE, 'k': 0::BIGINT}})"


def _drift(n: str, v: str, h: str, lat: str, lng: str) -> str:
    return _DRIFT.format(n=n, v=v, h=h, lat=lat, lng=lng)


_BEARING = "(degrees(atan2(sin(radians({x2} - {x1})) * cos(radians({y2})), cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos(radians({x2} - {x1})))) + 360)"


def _bearing(y1: str, x1: str, y2: str, x2: str) -> str:
    b = _BEARING.format(y1=y1, x1=x1, y2=y2, x2=x2)
    return f"({b} - 360 * floor({b} / 360))"


LOG_SQL = f"""
WITH RECURSIVE {TRACK_SQL},
timed AS (SELECT *, lead(t_ms) OVER (PARTITION BY ride_id ORDER BY seq) AS nxt FROM track),
paused AS (SELECT *, coalesce(sum(CASE WHEN stopped AND nxt IS NOT NULL THEN (nxt - t_ms) // 2 ELSE 0 END) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
  coalesce(sum((stopped AND nxt IS NOT NULL)::INT) OVER (PARTITION BY ride_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pauses FROM timed),
adm AS MATERIALIZED (SELECT ride_id, seq, t_ms, lat, lng, altitude, speed, off, pauses, row_number() OVER (PARTITION BY ride_id ORDER BY seq) AS i FROM paused WHERE seq = 0 OR accuracy <= 20),
g AS (
  SELECT ride_id, i, seq, t_ms, lat, lng, speed, off, pauses, t_ms - off AS t0, NULL::DOUBLE AS heading, 0::DOUBLE AS m, 0::DOUBLE AS before_m, NULL::DOUBLE AS at_lat, NULL::DOUBLE AS at_lng, 0::BIGINT AS n, NULL::BIGINT AS of_seq, NULL::BIGINT AS of_t, NULL::DOUBLE AS of_h, NULL::DOUBLE AS of_v, NULL::BIGINT AS of_off, 0::DOUBLE AS of_m
  FROM adm WHERE i = 1
  UNION ALL
  SELECT ride_id, i, seq, t_ms, lat, lng, speed, off, pauses, t0,
    CASE WHEN {hav_sql('from_lat', 'from_lng', 'lat', 'lng')} >= 2 THEN {_bearing('from_lat', 'from_lng', 'lat', 'lng')} ELSE of_h END,
    of_m + coalesce(way.m, 0) + {hav_sql('from_lat', 'from_lng', 'lat', 'lng')}, of_m, of_lat, of_lng, CASE WHEN way IS NULL THEN 0 ELSE steps END, of_seq, of_t, of_h, of_v, of_off, of_m
  FROM (
    SELECT *, coalesce(way.lat, of_lat) AS from_lat, coalesce(way.lng, of_lng) AS from_lng FROM (
      SELECT *, CASE WHEN far.k > 0 AND {hav_sql('far.lat', 'far.lng', 'lat', 'lng')} <= 50 THEN far END AS way FROM (
        SELECT *, CASE WHEN steps > 0 THEN {_drift('steps', 'of_v * 0.25', 'of_h', 'of_lat', 'of_lng')} END AS far FROM (
          SELECT a.ride_id, a.i, a.seq, a.t_ms, a.lat, a.lng, a.speed, a.off, a.pauses, g.t0, g.heading AS of_h, g.m AS of_m, g.lat AS of_lat, g.lng AS of_lng, g.seq AS of_seq, g.t_ms AS of_t, g.speed AS of_v, g.off AS of_off,
            CASE WHEN g.pauses = a.pauses AND g.heading IS NOT NULL AND a.t_ms - g.t_ms > 3500 THEN (a.t_ms - g.t_ms - 3501) // 250 ELSE 0 END AS steps
          FROM g JOIN adm a ON a.ride_id = g.ride_id AND a.i = g.i + 1)))) ),
sm AS (SELECT ride_id, seq, avg(altitude) OVER (PARTITION BY ride_id ORDER BY seq ROWS 4 PRECEDING) AS s FROM adm WHERE altitude IS NOT NULL),
dl AS (SELECT ride_id, seq, coalesce(s - lag(s) OVER (PARTITION BY ride_id ORDER BY seq), 0) AS d FROM sm),
tops AS MATERIALIZED (SELECT g.*, max(speed) OVER w AS top, coalesce(sum(greatest(d, 0)) OVER w, 0) AS gain, coalesce(sum(greatest(-d, 0)) OVER w, 0) AS fall,
  coalesce(lag(m) OVER w, 0) AS m_before FROM g LEFT JOIN dl USING (ride_id, seq) WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
fixes AS (SELECT ride_id, 'fix' AS kind, seq, 0::BIGINT AS k, t_ms, lat, lng, m, t_ms - off - t0 AS elapsed_ms, heading, top, gain, fall FROM tops),
cut AS (SELECT ride_id, 'split' AS kind, seq, unnest(range(floor(m_before / 100)::BIGINT + 1, floor(m / 100)::BIGINT + 1)) AS k, t_ms, lat, lng, m, t_ms - off - t0 AS at_ms, heading, top, gain, fall FROM tops),
splits AS (SELECT * REPLACE (at_ms - coalesce(lag(at_ms) OVER (PARTITION BY ride_id ORDER BY k), 0) AS at_ms) FROM cut),
path AS (SELECT *, unnest(list_transform(range(1, n + 1), lambda q: {{'k': q, 'x': {_drift('q', 'of_v * 0.25', 'of_h', 'at_lat', 'at_lng')}}})) AS e FROM g WHERE n > 0),
est AS (SELECT p.ride_id, 'estimated' AS kind, p.of_seq AS seq, e.k AS k, p.of_t + 3500 + e.k * 250 AS t_ms, e.x.lat AS lat, e.x.lng AS lng, p.of_m + e.x.m AS m, p.of_t + 3500 + e.k * 250 - p.of_off - p.t0 AS elapsed_ms, p.of_h AS heading, b.top, b.gain, b.fall
  FROM path p JOIN tops b ON b.ride_id = p.ride_id AND b.seq = p.of_seq)
SELECT ride_id, kind, seq, k, t_ms, round(lat, 6) AS lat, round(lng, 6) AS lng, round(m, 3) AS distance_m, elapsed_ms::BIGINT AS elapsed_ms, round(heading, 3) AS heading, round(top, 4) AS max_speed, round(gain, 4) AS gain, round(fall, 4) AS "drop"
FROM (SELECT * FROM fixes UNION ALL SELECT * FROM splits UNION ALL SELECT * FROM est)
"""

QUERIES = {"recorded_log": (recorded_log, LOG_SQL), "live_log": (live_log, LOG_SQL)}


GAP_MS, LATE_MS, PARTS = 10_000, 30_000, 4


def _arrivals(spark, d):
    """The tracks' fixes as they come in: most at once, some a minute or more later, some twice."""
    t = track(spark, d).select("ride_id", "seq", "t_ms", "speed")
    h = F.col("seq") * 31 + F.col("ride_id") * 7
    slow = F.when(h % 19 == 0, (h % 7 + 1) * 20_000).otherwise(0)
    again = F.when(h % 13 == 0, F.array(F.lit(0), F.lit(5_000))).otherwise(F.array(F.lit(0)))
    return t.withColumn("copy", F.explode(again)).withColumn("arrive", F.col("t_ms") + slow + F.col("copy")).drop("copy")


def _cuts(rows):
    lo, hi = rows.agg(F.min("arrive"), F.max("arrive")).first()
    return [] if lo is None else [lo + (hi - lo) * k // PARTS for k in range(1, PARTS)]


def session_stretches(spark, d):
    """Stretches by a gap in time, of fixes that are neither late nor doubled; those that are over by the watermark."""
    rows, base = _arrivals(spark, d), f"{shared_dir(spark)}/stretches-{uuid.uuid4().hex}"

    def run(stream):
        late.stretches(stream, GAP_MS, LATE_MS).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    late.replay(rows, base, _cuts(rows), "arrive", run)
    return spark.read.schema("ride_id long, start_ms long, last_ms long, n long, first_seq long, last_seq long, max_speed double").parquet(f"{base}/out")


def late_fixes(spark, d):
    """How many rows of each ride came too late."""
    rows, base = _arrivals(spark, d), f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"

    def run(stream):
        stream.writeStream.foreachBatch(late.sorted_out(base, LATE_MS)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

    late.replay(rows, base, _cuts(rows), "arrive", run)
    return spark.read.parquet(f"{base}/late").groupBy("ride_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


_ARRIVALS = f"""WITH {TRACK_SQL},
come AS (SELECT ride_id, seq, t_ms, speed, t_ms + CASE WHEN (seq * 31 + ride_id * 7) % 19 = 0 THEN ((seq * 31 + ride_id * 7) % 7 + 1) * 20000 ELSE 0 END + copy AS arrive
  FROM (SELECT *, unnest(CASE WHEN (seq * 31 + ride_id * 7) % 13 = 0 THEN [0, 5000] ELSE [0] END) AS copy FROM track)),
span AS (SELECT min(arrive) AS lo, max(arrive) AS hi FROM come),
part AS (SELECT come.*, (arrive >= lo + (hi - lo) // {PARTS})::INT + (arrive >= lo + (hi - lo) * 2 // {PARTS})::INT + (arrive >= lo + (hi - lo) * 3 // {PARTS})::INT AS k FROM come, span),
high AS (SELECT k, max(t_ms) AS top FROM part GROUP BY k),
mark AS (SELECT a.k, (SELECT max(top) FROM high b WHERE b.k < a.k) - {LATE_MS} AS wm FROM high a),
seen AS (SELECT part.*, coalesce(t_ms <= wm, false) AS is_late FROM part JOIN mark USING (k))"""
_SESSIONS = _ARRIVALS + f""",
kept AS (SELECT DISTINCT ride_id, seq, t_ms, speed FROM seen WHERE NOT is_late),
i0 AS (SELECT *, coalesce(t_ms - lag(t_ms) OVER (PARTITION BY ride_id ORDER BY t_ms, seq) > {GAP_MS}, false)::INT AS new FROM kept),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY ride_id ORDER BY t_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM i0)
SELECT ride_id, min(t_ms) AS start_ms, max(t_ms) AS last_ms, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, max(speed) AS max_speed FROM i1 GROUP BY ride_id, run HAVING max(t_ms) + {GAP_MS} <= (SELECT max(top) FROM high) - {LATE_MS}"""

QUERIES |= {"session_stretches": (session_stretches, _SESSIONS), "late_fixes": (late_fixes, _ARRIVALS + " SELECT ride_id, count(*) AS n, min(seq) AS first_seq FROM seen WHERE is_late GROUP BY ride_id")}
