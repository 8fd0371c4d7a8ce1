"""Queries over ride summaries, laps, sections and stored records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rides as R
from ..operators import spatial as S
from ..operators import tracks as T
from ..sources.lenses import FIX_SQL, LAP_SQL, RIDE_SQL, STEP_SQL, fix, lap, read, ride

NOW = "TIMESTAMP '2001-07-15 12:00:00'"


def r4(c: str) -> F.Column:
    return F.round(F.col(c) + 1e-9, 4).alias(c)


def month_week_totals(spark, d):
    t = R.period_totals(ride(spark, d), F.expr(NOW))
    return t.select(*[F.round(c, 3).alias(c) for c in ("month_distance", "week_distance", "month_speed")], *[F.col(c).cast("long") for c in ("month_ms", "month_rides", "week_ms", "week_rides")])


def calendar_days(spark, d):
    return R.calendar(ride(spark, d)).select(F.col("day").cast("string").alias("day"), "n", F.round("distance", 3).alias("distance"), F.col("ms").cast("long"), "first_id")


def calendar_scale(spark, d):
    return R.calendar_scale(ride(spark, d)).select(F.col("day").cast("string").alias("day"), r4("colour"), r4("pace"))


def month_bounds(spark, d):
    b = R.month_bounds(ride(spark, d), F.expr(NOW))
    return b.select(*[F.date_format(c, "yyyy-MM").alias(c) for c in b.columns])


def activity_pace_ranges(spark, d):
    return R.pace_ranges(ride(spark, d)).select("kind", r4("slowest"), r4("fastest"))


def ride_bars(spark, d):
    return R.bars(ride(spark, d)).select("id", r4("length"), r4("colour"), r4("fraction"))


def route_average(spark, d):
    return R.route_averages(ride(spark, d)).select("route_id", r4("speed"), "n")


def quantile_range(spark, d):
    best = R.best_pace(lap(spark, d), ["section_id", "direction"])
    return R.nearest_rank(best, ["direction"], "best", (0.1, 0.9, 0.95))


def rides_newest(spark, d):
    return R.newest_first(ride(spark, d), 50).select("id", F.col("start_ms"))


def merge_candidates(spark, d):
    return R.merge_candidates(ride(spark, d), F.lit(880_000_000_000)).select("id", "start_ms")


def merged_rides(spark, d):
    r = ride(spark, d).withColumn("day", F.date_format("date", "yyyy-MM-dd"))
    return R.merged(r, "day").select("day", "n", F.round("distance", 3).alias("distance"), F.col("ms").cast("long"), "first_id", "activity", "route_id", "end_ms")


def overlap_check(spark, d):
    return R.overlaps(ride(spark, d).withColumn("route", F.coalesce("route_id", F.lit(0))), "route").select("route", "overlap", "n_overlaps")


def year_dividers(spark, d):
    return R.year_dividers(ride(spark, d)).select(F.col("year").cast("long"), "id", "n")


def duration_text(spark, d):
    r = ride(spark, d)
    return r.select("id", C.duration_minutes(F.col("moving_time_ms")).alias("minutes"), C.clock(F.col("moving_time_ms")).alias("clock"))


def day_parts(spark, d):
    start = F.col("date") + F.expr("make_interval(0,0,0,0,0,0,(id * 997) % 86400)")
    r = ride(spark, d).withColumn("s", start).withColumn("e", F.col("s") + F.expr("make_interval(0,0,0,0,0,0,moving_time_ms div 1000)"))
    return r.select("id", C.day_part(F.col("s"), F.col("e")).alias("part"))


def import_dedupe(spark, d):
    r = ride(spark, d)
    return R.import_new(r.where("id % 3 = 0"), r).select("id")


def reconcile_summaries(spark, d):
    r = ride(spark, d)
    return R.reconcile(r.where("id % 5 <> 0"), r.where("id % 7 <> 0"))


def pending_rides(spark, d):
    return R.pending(ride(spark, d)).select("id", "start_ms")


def best_pace_fold(spark, d):
    b = R.best_pace(lap(spark, d), ["section_id", "direction"])
    return b.select("section_id", "direction", "passes", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "best", "best_ride_id")


def flat_twin_merge(spark, d):
    """Many averages lie on the bound, where the order of adding doubles decides: grades are added in the table's order."""
    so_far = F.sum("grade").over(Window.partitionBy("section_id", "direction").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    grade = F.try_divide(F.max_by("total", "place"), F.count("grade"))
    laps = lap(spark, d, placed=True).withColumn("total", so_far).groupBy("section_id", "direction").agg(F.count("*").alias("passes"), F.max("speed").alias("best"), F.max_by("ride_id", F.struct("speed", -F.col("ride_id"))).alias("best_ride_id"), grade.alias("grade"))
    return R.flat_twins(laps, 0.002).select("section_id", "twin", "passes", "best", "best_ride_id", "n")


def activity_mode(spark, d):
    return R.group_mode(R.with_defaults(ride(spark, d)), "kind")


def segment_bars(spark, d):
    s = lap(spark, d).groupBy(F.col("section_id").alias("ride_id"), F.col("direction").alias("segment")).agg(F.avg("speed").alias("avg_speed"))
    return R.segment_bars(s).select("ride_id", "segment", r4("width"), r4("colour"))


def infer_activity(spark, d):
    return read(spark, d, "part").select("p_partkey", C.infer_activity(F.concat_ws(" ", "p_name", "p_type")).alias("kind"))


def escape_html(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(C.escape_html(F.col("text")).cast("binary"), 256).alias("escaped"), F.sha2(C.slug(F.col("text")).cast("binary"), 256).alias("slug"))


def section_passes_by_ride(spark, d):
    """Left join of a section's best ride, which may be missing."""
    b = R.best_pace(lap(spark, d), ["section_id"])
    r = ride(spark, d).where("pace_mapped").select(F.col("id").alias("best_ride_id"), "activity", "route_id")
    return b.join(r, "best_ride_id", "left").select("section_id", "best_ride_id", "activity", "route_id")


def _spread(spark, d):
    """Fixes with rides dealt over 53 strips, 2.2 km apart, so that a place is met by the rides of its strip."""
    f = fix(spark, d)
    return T.steps(f.withColumn("lat", F.col("lat") + F.col("ride_id") % 53 * C.dbl(0.02)))


def _sections(spark, d):
    return S.sections_from(_spread(spark, d))


def _points(spark, d):
    return _spread(spark, d).select((F.col("ride_id") * 100_000 + F.col("seq")).alias("id"), "lat", "lng", C.flat_bearing(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")).alias("heading"))


def section_nearest(spark, d):
    return S.nearest_section(_points(spark, d), S.samples(_sections(spark, d))).select("id", "section_id", F.round("distance", 3).alias("distance"))


def sections_ahead(spark, d):
    return S.within(_points(spark, d), S.samples(_sections(spark, d))).select("id", "section_id", F.round("distance", 3).alias("distance"))


def sections_on_the_way(spark, d):
    """Every third section serves both ways."""
    s = _sections(spark, d).withColumn("both_ways", F.col("section_id") % 3 == 0)
    return S.ahead(_points(spark, d), s).select("id", "section_id", F.round("distance", 3).alias("distance"))


def section_samples(spark, d):
    return S.samples(_sections(spark, d)).groupBy("section_id").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"))


_SEGMENT = "l_orderkey * 10 + l_linenumber AS segment_id, (l_partkey % 97) * 7.0D AS ax, (l_suppkey % 89) * 7.0D + l_orderkey % 5 AS ay, (l_partkey % 97) * 7.0D + l_quantity - 25 AS bx, (l_suppkey % 89) * 7.0D + l_orderkey % 5 + l_discount * 500 - 25 AS by, CAST(l_linenumber AS BIGINT) AS level"


def _segments(spark, d):
    return read(spark, d, "lineitem").selectExpr(*[x.strip() for x in _SEGMENT.split(", ")]).groupBy("segment_id").agg(*[F.min(c).alias(c) for c in ("ax", "ay", "bx", "by", "level")])


def nearest_segment(spark, d):
    p = read(spark, d, "customer").selectExpr("c_custkey AS id", "(c_custkey % 101) * 6.5D AS x", "(c_custkey % 83) * 7.5D AS y")
    return S.to_segments(p, _segments(spark, d), side=20.0).select("id", "segment_id", F.round("distance", 4).alias("distance"))


def segment_crossings(spark, d):
    return S.crossings(_segments(spark, d), side=16.0).select("segment_id", "other", F.round(F.col("x") + 1e-9, 4).alias("x"), F.round(F.col("y") + 1e-9, 4).alias("y"))


def raster_heights(spark, d):
    h = spark.range(0, 40 * 40).selectExpr("id % 40 AS gx", "id div 40 AS gy", "CAST((id * 37) % 101 AS DOUBLE) AS height")
    p = read(spark, d, "customer").selectExpr("c_custkey AS id", "(c_custkey * 13 % 4100) / 100D AS px", "(c_custkey * 29 % 4100) / 100D AS py")
    return S.bilinear(p, h).select("id", F.round("height", 4).alias("height"))


def checkpoint_scan(spark, d):
    f = fix(spark, d)
    chunks = f.groupBy("ride_id", (F.col("seq") - F.col("seq") % 8).alias("start")).agg(F.array_sort(F.collect_list(F.struct("seq", "t_ms"))).alias("points"))
    later = chunks.where("start % 16 = 8").select("ride_id", (F.col("start") - 1).alias("start"), F.expr("transform(points, p -> named_struct('seq', p.seq - 1, 't_ms', p.t_ms + 1))").alias("points"))
    return R.checkpoint_overlay(chunks.unionByName(later)).select("ride_id", "idx", F.col("point.t_ms").alias("t_ms"))


def preference_scan(spark, d):
    rows = read(spark, d, "customer").groupBy(F.concat(F.lit("k"), F.col("c_nationkey")).alias("key")).agg(F.min("c_mktsegment").alias("value"))
    domains = {f"k{i}": (("AUTOMOBILE", "BUILDING") if i % 2 else ("MACHINERY",), "none") for i in range(30)}
    return R.preferences(rows, domains)


_R = "WITH " + RIDE_SQL
_L = "WITH " + LAP_SQL
_FR = ", fr AS (SELECT *, min(CASE WHEN speed > 0 THEN speed END) OVER (PARTITION BY kind) AS lo, max(CASE WHEN speed > 0 THEN speed END) OVER (PARTITION BY kind) AS hi FROM rides), f AS (SELECT *, CASE WHEN hi - lo >= 0.05 THEN (speed - lo) / (hi - lo) ELSE 0.5 END AS fraction FROM fr)"
_N = "TIMESTAMP '2001-07-15 12:00:00'"
_SEC = ", e AS (SELECT ride_id, seq // 5 AS k, lat + ride_id % 53 * 0.02::DOUBLE AS lat, lng, speed FROM fix WHERE seq % 5 = 0), s0 AS (SELECT *, lead(lat) OVER (PARTITION BY ride_id ORDER BY k) AS lat2, lead(lng) OVER (PARTITION BY ride_id ORDER BY k) AS lng2 FROM e), sec AS (SELECT ride_id, ride_id * 100000 + k AS section_id, lat, lng, lat2, lng2, degrees(atan2((lng2 - lng) * 111320 * cos(radians((lat + lat2) / 2)), (lat2 - lat) * 110574)) AS b, greatest(1, ceil(sqrt(pow((lat2 - lat) * 110574, 2) + pow((lng2 - lng) * 111320 * cos(radians((lat + lat2) / 2)), 2)) / 8))::BIGINT AS n FROM s0 WHERE lat2 IS NOT NULL), smp0 AS (SELECT *, unnest(range(0, n + 1)) AS i FROM sec), smp AS (SELECT ride_id % 53 AS strip, section_id, b, lat + (lat2 - lat) * (i / n) AS lat, lng + (lng2 - lng) * (i / n) AS lng FROM smp0), moved AS (SELECT ride_id, seq, lat + ride_id % 53 * 0.02::DOUBLE AS lat, plat + ride_id % 53 * 0.02::DOUBLE AS plat, lng, plng FROM step0), pts AS (SELECT ride_id * 100000 + seq AS id, ride_id % 53 AS strip, lat, lng, degrees(atan2((lng - plng) * 111320 * cos(radians((plat + lat) / 2)), (lat - plat) * 110574)) AS h FROM moved)"
_D = "sqrt(pow((s.lat - p.lat) * 110574, 2) + pow((s.lng - p.lng) * 111320 * cos(radians((p.lat + s.lat) / 2)), 2))"
_TO = "degrees(atan2(({lng} - p.lng) * 111320 * cos(radians((p.lat + {lat}) / 2)), ({lat} - p.lat) * 110574))"
_ASIDE = "round(least(abs({a} - ({b})) % 360, 360 - abs({a} - ({b})) % 360), 6)"


def _to_come(lat, lng):
    metres = f"round(sqrt(pow(({lat} - p.lat) * 110574, 2) + pow(({lng} - p.lng) * 111320 * cos(radians((p.lat + {lat}) / 2)), 2)), 6)"
    return f"({metres} > 5 AND (h IS NULL OR {_ASIDE.format(a='h', b=_TO.format(lat=lat, lng=lng))} < 90))"


_OUT = _TO.format(lat="((s.lat + s.lat2) / 2)", lng="((s.lng + s.lng2) / 2)")
_AHEAD = (
    f", m AS (SELECT p.id, s.section_id, min({_D}) AS d FROM pts p JOIN smp s ON s.strip = p.strip WHERE {_D} <= 150 GROUP BY ALL), "
    f"c AS (SELECT m.*, h IS NULL AS free, s.section_id % 3 = 0 AS two, {_ASIDE.format(a='h', b='s.b')} AS off, {_to_come('s.lat2', 's.lng2')} AS e1, {_to_come('s.lat', 's.lng')} AS e0, "
    f"{_ASIDE.format(a='h', b=_OUT)} AS aside, {_ASIDE.format(a='s.b', b=_OUT)} AS leads FROM m JOIN pts p USING (id) JOIN sec s USING (section_id) WHERE s.speed IS NOT NULL) "
    "SELECT id, section_id, round(d, 3) AS distance FROM c WHERE CASE WHEN round(d, 6) <= 30 THEN (e1 OR (two AND e0)) AND (free OR CASE WHEN two THEN least(off, 180 - off) ELSE off END <= 45) ELSE (free OR aside <= 100) AND (two OR leads < 90) END"
)
_SEG = "WITH seg0 AS (SELECT " + _SEGMENT.replace("7.0D", "7.0::DOUBLE").replace(" AS by", " AS dy") + " FROM lineitem), seg AS (SELECT segment_id, min(ax) AS ax, min(ay) AS ay, min(bx) AS bx, min(dy) AS dy, min(level) AS level FROM seg0 GROUP BY segment_id)"

QUERIES = {
    "month_week_totals": (month_week_totals, _R + f", x AS (SELECT *, date >= date_trunc('month', {_N}) AS m, date >= date_trunc('day', {_N}) - INTERVAL 6 DAY AS w FROM ride) SELECT round(sum(CASE WHEN m THEN total_distance ELSE 0 END), 3) AS month_distance, round(sum(CASE WHEN w THEN total_distance ELSE 0 END), 3) AS week_distance, round(CASE WHEN sum(CASE WHEN m THEN moving_time_ms ELSE 0 END) = 0 THEN 0 ELSE sum(CASE WHEN m THEN total_distance ELSE 0 END) / (sum(CASE WHEN m THEN moving_time_ms ELSE 0 END) / 1000) END, 3) AS month_speed, sum(CASE WHEN m THEN moving_time_ms ELSE 0 END)::BIGINT AS month_ms, sum(m::INT)::BIGINT AS month_rides, sum(CASE WHEN w THEN moving_time_ms ELSE 0 END)::BIGINT AS week_ms, sum(w::INT)::BIGINT AS week_rides FROM x"),
    "calendar_days": (calendar_days, _R + "SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n, round(sum(total_distance), 3) AS distance, sum(moving_time_ms)::BIGINT AS ms, min(id) AS first_id FROM ride GROUP BY 1"),
    "calendar_scale": (calendar_scale, _R + _FR + ", g AS (SELECT strftime(date, '%Y-%m-%d') AS day, sum(total_distance) AS dist, sum(fraction * greatest(total_distance, 1)) / sum(greatest(total_distance, 1)) AS pace FROM f GROUP BY 1) SELECT day, round(CASE WHEN max(dist) OVER () > min(dist) OVER () THEN (dist - min(dist) OVER ()) / (max(dist) OVER () - min(dist) OVER ()) ELSE 0.5 END + 1e-9, 4) AS colour, round(pace + 1e-9, 4) AS pace FROM g"),
    "month_bounds": (month_bounds, _R + f"SELECT strftime(least(date_trunc('month', min(date)), date_trunc('month', {_N})), '%Y-%m') AS first, strftime(greatest(date_trunc('month', max(date)), date_trunc('month', {_N})), '%Y-%m') AS last, strftime(date_trunc('month', max(date)), '%Y-%m') AS shown FROM ride"),
    "activity_pace_ranges": (activity_pace_ranges, _R + "SELECT kind, round(min(speed) + 1e-9, 4) AS slowest, round(max(speed) + 1e-9, 4) AS fastest FROM rides WHERE speed > 0 GROUP BY kind"),
    "ride_bars": (ride_bars, _R + _FR + "SELECT id, round(total_distance / max(total_distance) OVER () + 1e-9, 4) AS length, round((total_distance - min(total_distance) OVER ()) / (max(total_distance) OVER () - min(total_distance) OVER ()) + 1e-9, 4) AS colour, round(fraction + 1e-9, 4) AS fraction FROM f"),
    "route_average": (route_average, _R + "SELECT route_id, round(sum(total_distance) / (sum(moving_time_ms) / 1000) + 1e-9, 4) AS speed, count(*) AS n FROM ride WHERE route_id IS NOT NULL AND moving_time_ms > 0 GROUP BY route_id"),
    "quantile_range": (quantile_range, _L + ", b AS (SELECT section_id, direction, max(speed) AS best FROM lap GROUP BY ALL), q AS (SELECT direction, list_sort(list(best)) AS l FROM b GROUP BY direction) SELECT direction, l[least(len(l) - 1, floor(0.1::DOUBLE * len(l))::BIGINT) + 1] AS q10, l[least(len(l) - 1, floor(0.9::DOUBLE * len(l))::BIGINT) + 1] AS q90, l[least(len(l) - 1, floor(0.95::DOUBLE * len(l))::BIGINT) + 1] AS q95 FROM q"),
    "rides_newest": (rides_newest, _R + "SELECT id, start_ms FROM ride ORDER BY date DESC, id DESC LIMIT 50"),
    "merge_candidates": (merge_candidates, _R + "SELECT id, start_ms FROM ride ORDER BY abs(start_ms - 880000000000), id LIMIT 20"),
    "merged_rides": (merged_rides, _R + "SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS n, round(sum(total_distance), 3) AS distance, sum(moving_time_ms)::BIGINT AS ms, min(id) AS first_id, first(activity ORDER BY id) AS activity, CASE WHEN count(DISTINCT coalesce(route_id, -1)) = 1 THEN min(route_id) END AS route_id, max(end_ms) AS end_ms FROM ride GROUP BY 1"),
    "overlap_check": (overlap_check, _R + ", o AS (SELECT coalesce(route_id, 0) AS route, coalesce(start_ms < lag(end_ms) OVER (PARTITION BY coalesce(route_id, 0) ORDER BY start_ms, id), false) AS o FROM ride) SELECT route, bool_or(o) AS overlap, sum(o::INT)::BIGINT AS n_overlaps FROM o GROUP BY route"),
    "year_dividers": (year_dividers, _R + "SELECT year(date)::BIGINT AS year, last(id ORDER BY date, id) AS id, count(*) AS n FROM ride GROUP BY 1"),
    "duration_text": (duration_text, _R + ", m AS (SELECT id, floor(moving_time_ms / 60000 + 0.5)::BIGINT AS m, (moving_time_ms // 1000)::BIGINT AS s FROM ride) SELECT id, CASE WHEN m < 1 THEN '<1m' WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS minutes, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM m"),
    "day_parts": (day_parts, _R + ", t AS (SELECT id, date + to_seconds((id * 997) % 86400) AS s, moving_time_ms // 1000 AS n FROM ride), u AS (SELECT id, s, s + to_seconds(n) AS e FROM t) SELECT id, CASE WHEN s::DATE <> e::DATE OR (hour(s) < 12 AND hour(e) >= 12) THEN 'All day' WHEN hour(s) < 12 THEN 'Morning' WHEN hour(s) < 17 THEN 'Afternoon' ELSE 'Evening' END AS part FROM u"),
    "import_dedupe": (import_dedupe, _R + ", k AS (SELECT id, start_ms || '|' || floor(total_distance + 0.5)::BIGINT AS k FROM ride), n AS (SELECT id, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM k WHERE k NOT IN (SELECT k FROM k WHERE id % 3 = 0)) SELECT id FROM n WHERE r = 1"),
    "reconcile_summaries": (reconcile_summaries, _R + "SELECT id, CASE WHEN id % 7 = 0 THEN 'insert' ELSE 'delete' END AS action FROM ride WHERE (id % 5 <> 0) <> (id % 7 <> 0)"),
    "pending_rides": (pending_rides, _R + "SELECT id, start_ms FROM ride WHERE NOT pace_mapped"),
    "best_pace_fold": (best_pace_fold, _L + "SELECT section_id, direction, count(*) AS passes, strftime(min(ride_date), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ride_date), '%Y-%m-%d %H:%M:%S') AS last_date, max(speed) AS best, first(ride_id ORDER BY speed DESC, ride_date, ride_id) AS best_ride_id FROM lap GROUP BY ALL"),
    "flat_twin_merge": (flat_twin_merge, _L + ", b AS (SELECT section_id, direction, count(*) AS passes, max(speed) AS best, first(ride_id ORDER BY speed DESC, ride_id) AS best_ride_id, avg(grade) AS grade FROM lap GROUP BY ALL) SELECT section_id, CASE WHEN abs(grade) <= 0.002 THEN 'both' ELSE direction END AS twin, sum(passes)::BIGINT AS passes, max(best) AS best, first(best_ride_id ORDER BY best DESC, best_ride_id) AS best_ride_id, count(*) AS n FROM b GROUP BY 1, 2"),
    "activity_mode": (activity_mode, _R + ", c AS (SELECT kind, count(*) AS n FROM rides GROUP BY kind) SELECT kind, n, kind = (SELECT kind FROM c ORDER BY n DESC, kind LIMIT 1) AS most_common FROM c"),
    "segment_bars": (segment_bars, _L + ", s AS (SELECT section_id AS ride_id, direction AS segment, avg(speed) AS v FROM lap GROUP BY ALL), w AS (SELECT *, greatest(max(v) OVER (PARTITION BY ride_id), 0.0001) AS f, min(v) OVER (PARTITION BY ride_id) AS l FROM s) SELECT ride_id, segment, round(greatest(2, v / f * 100) + 1e-9, 4) AS width, round(CASE WHEN f - l > 0.01 THEN (v - l) / (f - l) ELSE 1 END + 1e-9, 4) AS colour FROM w"),
    "infer_activity": (infer_activity, "WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, 'hik') THEN 'hike' WHEN regexp_matches(t, 'kayak|paddle|canoe') THEN 'kayak' WHEN regexp_matches(t, 'run|walk') THEN 'walk' ELSE 'bike' END AS kind FROM t"),
    "escape_html": (escape_html, "SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped, sha256(coalesce(nullif(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'route')) AS slug FROM documents"),
    "section_passes_by_ride": (section_passes_by_ride, _L + ", " + RIDE_SQL + ", b AS (SELECT section_id, first(ride_id ORDER BY speed DESC, ride_date, ride_id) AS best_ride_id FROM lap GROUP BY section_id) SELECT section_id, best_ride_id, activity, route_id FROM b LEFT JOIN (SELECT id, activity, route_id FROM ride WHERE pace_mapped) r ON r.id = b.best_ride_id"),
    "section_nearest": (section_nearest, "WITH " + STEP_SQL + _SEC + f", m AS (SELECT p.id, s.section_id, {_D} AS d FROM pts p JOIN smp s ON s.strip = p.strip WHERE least(abs(h - b) % 360, 360 - abs(h - b) % 360) <= 45 OR h IS NULL) SELECT id, first(section_id ORDER BY round(d, 6), section_id DESC) AS section_id, round(min(d), 3) AS distance FROM m WHERE d <= 25 GROUP BY id"),
    "sections_ahead": (sections_ahead, "WITH " + STEP_SQL + _SEC + f", m AS (SELECT p.id, s.section_id, {_D} AS d FROM pts p JOIN smp s ON s.strip = p.strip) SELECT id, section_id, round(min(d), 3) AS distance FROM m WHERE d <= 150 GROUP BY ALL"),
    "sections_on_the_way": (sections_on_the_way, "WITH " + STEP_SQL + _SEC.replace("lat2, lng2, degrees", "lat2, lng2, speed, degrees") + _AHEAD),
    "section_samples": (section_samples, "WITH " + STEP_SQL + _SEC + "SELECT section_id, count(*) AS n, round(avg(lat), 6) AS lat FROM smp GROUP BY section_id"),
    "nearest_segment": (nearest_segment, _SEG + ", p AS (SELECT c_custkey AS id, (c_custkey % 101) * 6.5::DOUBLE AS x, (c_custkey % 83) * 7.5::DOUBLE AS y FROM customer), u AS (SELECT *, CASE WHEN ax = bx AND ay = dy THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (dy - ay)) / (pow(bx - ax, 2) + pow(dy - ay, 2)))) END AS u FROM p JOIN seg ON x BETWEEN least(ax, bx) - 20 AND greatest(ax, bx) + 20 AND y BETWEEN least(ay, dy) - 20 AND greatest(ay, dy) + 20), d AS (SELECT id, segment_id, sqrt(pow(x - ax - u * (bx - ax), 2) + pow(y - ay - u * (dy - ay), 2)) AS d FROM u) SELECT id, first(segment_id ORDER BY round(d, 6), segment_id) AS segment_id, round(min(d), 4) AS distance FROM d WHERE d <= 20 GROUP BY id"),
    "segment_crossings": (segment_crossings, _SEG + ", j AS (SELECT a.segment_id, b.segment_id AS other, a.ax, a.ay, a.bx - a.ax AS rx, a.dy - a.ay AS ry, b.bx - b.ax AS sx, b.dy - b.ay AS sy, b.ax - a.ax AS qx, b.ay - a.ay AS qy FROM seg a JOIN seg b ON a.level = b.level AND a.segment_id < b.segment_id AND least(a.ax, a.bx) <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) <= greatest(a.ax, a.bx) AND least(a.ay, a.dy) <= greatest(b.ay, b.dy) AND least(b.ay, b.dy) <= greatest(a.ay, a.dy)), k AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS u, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS v FROM j WHERE rx * sy - ry * sx <> 0) SELECT segment_id, other, round(ax + u * rx + 1e-9, 4) AS x, round(ay + u * ry + 1e-9, 4) AS y FROM k WHERE u > 0 AND u < 1 AND v > 0 AND v < 1"),
    "raster_heights": (raster_heights, "WITH h AS (SELECT i % 40 AS gx, i // 40 AS gy, ((i * 37) % 101)::DOUBLE AS height FROM range(1600) r(i)), p AS (SELECT c_custkey AS id, (c_custkey * 13 % 4100) / 100::DOUBLE AS px, (c_custkey * 29 % 4100) / 100::DOUBLE AS py FROM customer), c AS (SELECT id, floor(px)::BIGINT + i AS gx, floor(py)::BIGINT + j AS gy, CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w FROM p, range(2) a(i), range(2) b(j)) SELECT id, round(CASE WHEN count(height) = 4 THEN sum(w * height) END, 4) AS height FROM c LEFT JOIN h USING (gx, gy) GROUP BY id"),
    "checkpoint_scan": (checkpoint_scan, "WITH " + FIX_SQL + ", n AS (SELECT ride_id, seq AS idx, t_ms, seq - seq % 8 AS start FROM fix UNION ALL SELECT ride_id, seq - 1, t_ms + 1, seq - seq % 8 - 1 FROM fix WHERE (seq - seq % 8) % 16 = 8) SELECT ride_id, idx, arg_max(t_ms, start) AS t_ms FROM n GROUP BY ALL"),
    "preference_scan": (preference_scan, "WITH r AS (SELECT 'k' || c_nationkey AS key, min(c_mktsegment) AS v FROM customer GROUP BY 1) SELECT 'k' || i AS key, CASE WHEN (i % 2 = 1 AND v IN ('AUTOMOBILE', 'BUILDING')) OR (i % 2 = 0 AND v = 'MACHINERY') THEN v ELSE 'none' END AS value FROM range(30) t(i) LEFT JOIN r ON r.key = 'k' || i"),
}
