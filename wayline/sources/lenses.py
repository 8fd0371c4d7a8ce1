"""Trip-shaped views over the provided tables, in Spark and, for the oracle, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import dbl


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp"))


def fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per position fix."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.select(F.col("user_id").alias("ride_id"), seq.cast("long").alias("seq"), F.floor(micros(F.col("ts")) / F.lit(5_000_000)).cast("long").alias("t_ms"), "event_type", "value", k.alias("k"))
    return e.select(
        "ride_id", "seq", "t_ms",
        (dbl(40) + F.col("seq") * dbl(0.00009)).alias("lat"), (dbl(-105) + F.col("value") * dbl(0.000001)).alias("lng"),
        F.when(F.col("event_type") != "error", dbl(100) + F.col("k") * dbl(0.5)).alias("altitude"),
        (F.col("value") / 20).alias("speed"),
        F.when(F.col("event_type") != "signup", dbl(8) + F.col("k") * dbl(0.15)).alias("accuracy"),
        (F.col("event_type") == "purchase").alias("estimated"),
        (F.col("event_type") == "error").alias("stopped"),
    )


def pause(fixes: DataFrame) -> DataFrame:
    nxt = F.lead("t_ms").over(Window.partitionBy("ride_id").orderBy("seq"))
    p = fixes.select("ride_id", "stopped", F.col("t_ms").alias("start"), F.expr("t_ms + (lead(t_ms) OVER (PARTITION BY ride_id ORDER BY seq) - t_ms) div 2").alias("stop"), nxt.alias("nxt"))
    return p.where("stopped AND nxt IS NOT NULL").select("ride_id", "start", "stop")


def ride(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    moving = (F.col("o_orderkey") * 37 % 7200 + 300) * 1000
    start = F.floor(micros(F.col("o_orderdate")) / F.lit(1000)).cast("long")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("date"),
        F.when(first == "1", "bike").when(first == "2", "walk").when(first == "3", "hike").when(first == "4", "kayak").alias("activity"),
        (F.col("o_totalprice") / 10).alias("total_distance"), moving.alias("moving_time_ms"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 10 / (moving / 1000)).alias("avg_speed"),
        F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("route_id"), (F.col("o_orderstatus") == "F").alias("pace_mapped"),
        start.alias("start_ms"), (start + moving).alias("end_ms"),
    )


def lap(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """One row per lap; `placed` adds `place`, where it stands in its table."""
    l, o, p = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    if placed:
        l = l.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    laps = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return laps.select(
        F.col("l_partkey").alias("section_id"), F.col("l_linestatus").alias("direction"), F.col("l_orderkey").alias("ride_id"),
        F.col("o_orderdate").cast("timestamp").alias("ride_date"), (F.col("l_quantity") / 4).alias("speed"), (F.col("l_discount") - dbl(0.05)).alias("grade"), (F.col("p_size") + dbl(60)).alias("meters"),
        *["place"][: int(placed)],
    )


# The same views for DuckDB.
FIX_SQL = """
fix0 AS (SELECT user_id AS ride_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, epoch_us(ts) // 5000000 AS t_ms,
  event_type, value, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS k FROM events),
fix AS (SELECT ride_id, seq, t_ms, 40::DOUBLE + seq * 0.00009::DOUBLE AS lat, (-105)::DOUBLE + value * 0.000001::DOUBLE AS lng,
  CASE WHEN event_type <> 'error' THEN 100::DOUBLE + k * 0.5::DOUBLE END AS altitude, value / 20 AS speed,
  CASE WHEN event_type <> 'signup' THEN 8::DOUBLE + k * 0.15::DOUBLE END AS accuracy, event_type = 'purchase' AS estimated, event_type = 'error' AS stopped FROM fix0),
pause AS (SELECT ride_id, t_ms AS start, t_ms + (nxt - t_ms) // 2 AS stop FROM (SELECT *, lead(t_ms) OVER (PARTITION BY ride_id ORDER BY seq) AS nxt FROM fix) WHERE stopped AND nxt IS NOT NULL)
"""


def hav_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(12742000 * atan2(sqrt({a}), sqrt(1 - {a})))"


STEP_SQL = (
    FIX_SQL
    + f""",
step0 AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng, lag(t_ms) OVER w AS pt, lag(speed) OVER w AS pspeed FROM fix WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
step1 AS (SELECT *, coalesce({hav_sql('plat', 'plng', 'lat', 'lng')}, 0) AS step_m FROM step0),
paused AS (SELECT s.ride_id, s.seq, sum(least(p.stop, s.t_ms) - greatest(p.start, s.pt)) AS off FROM step1 s JOIN pause p ON p.ride_id = s.ride_id AND p.start < s.t_ms AND p.stop > s.pt GROUP BY ALL),
step AS (SELECT s.*, coalesce(greatest(0, s.t_ms - s.pt - coalesce(off, 0)), 0) AS step_ms FROM step1 s LEFT JOIN paused USING (ride_id, seq)),
run AS (SELECT *, sum(step_m) OVER w AS cum_m, sum(step_ms) OVER w AS cum_ms FROM step WINDOW w AS (PARTITION BY ride_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
"""
)

RIDE_SQL = """
ride AS (SELECT o_orderkey AS id, o_orderdate AS date, CASE left(o_orderpriority, 1) WHEN '1' THEN 'bike' WHEN '2' THEN 'walk' WHEN '3' THEN 'hike' WHEN '4' THEN 'kayak' END AS activity,
  o_totalprice / 10 AS total_distance, 1000 * (300 + (o_orderkey * 37) % 7200) AS moving_time_ms,
  CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 10 / (300 + (o_orderkey * 37) % 7200)::DOUBLE END AS avg_speed,
  nullif(o_custkey % 7, 0) AS route_id, o_orderstatus = 'F' AS pace_mapped, epoch_us(o_orderdate) // 1000 AS start_ms,
  epoch_us(o_orderdate) // 1000 + 1000 * (300 + (o_orderkey * 37) % 7200) AS end_ms FROM orders),
rides AS (SELECT *, coalesce(nullif(activity, ''), 'bike') AS kind, coalesce(avg_speed, total_distance / (moving_time_ms / 1000)) AS speed FROM ride)
"""

LAP_SQL = """
lap AS (SELECT l_partkey AS section_id, l_linestatus AS direction, l_orderkey AS ride_id, o_orderdate AS ride_date, l_quantity / 4 AS speed,
  l_discount - 0.05::DOUBLE AS grade, p_size + 60::DOUBLE AS meters FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
"""


def _hash32(c) -> F.Column:
    """A number from 0 to 2^32 - 1 that SQL gives alike."""
    return F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes on winding ways: each goes on from the one before at its speed, turned by up to 30 degrees; some stray by
    some metres, as a receiver's do."""
    w, upto = Window.partitionBy("user_id").orderBy("event_id"), Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("double").alias("k"), F.floor(micros(F.col("ts")) / F.lit(5_000_000)).cast("bigint").alias("t_ms"), _hash32(F.col("event_id")).alias("h"))
    e = e.withColumns({"seq": (F.row_number().over(w) - 1).cast("bigint"), "dt": F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w), F.lit(0))})
    e = e.withColumn("way", F.radians((F.col("user_id") * 37 % 360 + F.sum(F.col("h") % 61 - 30).over(upto)).cast("double")))
    step = (F.col("value") / 20 + dbl(1)) * F.least(F.col("dt"), F.lit(20000)) / 1000
    e = e.withColumns({"north": F.sum(step * F.cos("way")).over(upto) + (F.col("h") % 7 - 3), "east": F.sum(step * F.sin("way")).over(upto) + (F.col("h") % 5 - 2)})
    return e.select(
        F.col("user_id").alias("ride_id"), "seq", "t_ms",
        F.round(dbl(40) + F.col("user_id") * dbl(0.001) + F.col("north") / 111320, 7).alias("lat"), F.round(dbl(-105) + F.col("east") / 85275, 7).alias("lng"),
        F.when(F.col("event_type") != "error", dbl(100) + F.col("k") * dbl(0.5)).alias("altitude"),
        (F.col("value") / 20 + dbl(1)).alias("speed"), F.when(F.col("event_type") != "signup", dbl(8) + F.col("k") * dbl(0.15)).alias("accuracy"), (F.col("event_type") == "error").alias("stopped"),
    )


def recording(fixes: DataFrame) -> DataFrame:
    """Fixes with the rider's pauses, each from a stopped fix halfway to the next, as rows in the order of time."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    f = fixes.withColumn("nxt", F.lead("t_ms").over(w))
    none = [F.lit(None).cast("double").alias(c) for c in ("lat", "lng", "altitude", "speed", "accuracy")]
    fix_rows = f.select("ride_id", "t_ms", (F.col("seq") * 2).alias("n"), F.lit("fix").alias("kind"), "seq", "lat", "lng", "altitude", "speed", "accuracy")
    at = f.where("stopped AND nxt IS NOT NULL")
    ends = at.select("ride_id", F.explode(F.array(F.struct("t_ms", F.lit("pause").alias("kind")), F.struct(F.expr("t_ms + (nxt - t_ms) div 2").alias("t_ms"), F.lit("resume").alias("kind")))).alias("x"), "seq")
    return fix_rows.unionByName(ends.select("ride_id", "x.t_ms", (F.col("seq") * 2 + 1).alias("n"), "x.kind", "seq", *none))


TRACK_SQL = """
track0 AS (SELECT event_id, user_id, event_type, value, regexp_extract(props, '"k": *([0-9]+)', 1)::DOUBLE AS k, epoch_us(ts) // 5000000 AS t_ms,
  ('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT AS h, row_number() OVER w - 1 AS seq, coalesce(epoch_us(ts) // 5000000 - lag(epoch_us(ts) // 5000000) OVER w, 0) AS dt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
track1 AS (SELECT *, radians((user_id * 37 % 360 + sum(h % 61 - 30) OVER w)::DOUBLE) AS way FROM track0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
track2 AS (SELECT *, sum((value / 20 + 1) * least(dt, 20000) / 1000 * cos(way)) OVER w + (h % 7 - 3) AS north, sum((value / 20 + 1) * least(dt, 20000) / 1000 * sin(way)) OVER w + (h % 5 - 2) AS east
  FROM track1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
track AS (SELECT user_id AS ride_id, seq, t_ms, round(40::DOUBLE + user_id * 0.001::DOUBLE + north / 111320, 7) AS lat, round(-105::DOUBLE + east / 85275, 7) AS lng,
  CASE WHEN event_type <> 'error' THEN 100::DOUBLE + k * 0.5::DOUBLE END AS altitude, value / 20 + 1 AS speed,
  CASE WHEN event_type <> 'signup' THEN 8::DOUBLE + k * 0.15::DOUBLE END AS accuracy, event_type = 'error' AS stopped FROM track2)
"""


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads under the tracks, in metres east and north of theirs: orders as crossings of a bent grid, 40 to a row, each
    with a street to the next and to the one north of it, of which some are missing. Every fifth line is a main road."""
    k = F.col("o_orderkey")
    o = read(spark, sf_dir, "orders").select(k.alias("k"), _hash32(k).alias("h"))
    node = o.select("k", "h", ((F.col("k") % 40 - 20) * 80 + F.col("h") % 21 - 10).cast("double").alias("x"), (F.expr("k div 40") * 45 - 600 + F.expr("h div 32") % 21 - 10).cast("double").alias("y"))
    far = node.select(F.col("k").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    ways = F.array(F.struct(F.lit(0).alias("to_north"), (F.col("k") + 1).alias("b"), (F.expr("k div 40") % 5 == 0).alias("main")), F.struct(F.lit(1).alias("to_north"), (F.col("k") + 40).alias("b"), (F.col("k") % 40 % 5 == 0).alias("main")))
    e = node.select(F.col("k").alias("a"), "h", F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(ways).alias("w")).select("a", "h", "ax", "ay", "w.*")
    there = F.when(F.col("to_north") == 0, (F.col("a") % 40 < 39) & (F.col("h") % 7 != 0)).otherwise(F.col("h") % 11 != 1)
    rank = F.when(F.col("main"), 1).when(F.col("h") % 13 == 2, 3).otherwise(2)
    e = e.where(there).join(far, "b").withColumns({"edge": F.col("a") * 2 + F.col("to_north"), "rank": rank, "meters": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))})
    return e.select("edge", "a", "b", "rank", (F.col("rank") == 3).alias("path"), "meters", "ax", "ay", "bx", "by")


def track_points(fixes: DataFrame) -> DataFrame:
    """The tracks' fixes in metres; some are estimated."""
    return fixes.select("ride_id", "seq", "t_ms", ((F.col("lng") + 105) * 85275).alias("x"), ((F.col("lat") - 40) * 111320).alias("y"), (F.col("seq") % 17 == 13).alias("estimated"))


STREETS_SQL = """
node AS (SELECT o_orderkey AS k, ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT AS h FROM orders),
spot AS (SELECT k, h, ((k % 40 - 20) * 80 + h % 21 - 10)::DOUBLE AS x, ((k // 40) * 45 - 600 + (h // 32) % 21 - 10)::DOUBLE AS y FROM node),
line AS (SELECT k AS a, h, x, y, 0 AS north, k + 1 AS b, (k // 40) % 5 = 0 AS main FROM spot WHERE k % 40 < 39 AND h % 7 <> 0 UNION ALL SELECT k, h, x, y, 1, k + 40, k % 40 % 5 = 0 FROM spot WHERE h % 11 <> 1),
street AS (SELECT l.a * 2 + north AS edge, l.a, l.b, CASE WHEN main THEN 1 WHEN l.h % 13 = 2 THEN 3 ELSE 2 END AS rank, NOT main AND l.h % 13 = 2 AS path, sqrt(pow(s.x - l.x, 2) + pow(s.y - l.y, 2)) AS meters, l.x AS ax, l.y AS ay, s.x AS bx, s.y AS yy FROM line l JOIN spot s ON s.k = l.b)
"""
TRACK_POINTS_SQL = "point AS (SELECT ride_id, seq, t_ms, stopped, (lng + 105) * 85275 AS x, (lat - 40) * 111320 AS y, seq % 17 = 13 AS estimated FROM track)"


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets with short paths off every second crossing, most of which end in the open; some lie a level higher."""
    s = streets(spark, sf_dir).select("edge", "a", "b", "meters", "ax", "ay", "bx", "by", "path", F.lit(0).alias("level"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _hash32(F.col("o_orderkey")).alias("h")).where("h % 2 = 0")
    x, y = (F.col("k") % 40 - 20) * 80 + F.col("h") % 21 - 10, F.expr("k div 40") * 45 - 600 + F.expr("h div 32") % 21 - 10
    dx, dy = F.col("h") % 71 - 20, F.expr("h div 128") % 29 + 1
    stub = o.select((-F.col("k") - 1).alias("edge"), F.col("k").alias("a"), (-F.col("k") - 1).alias("b"), F.hypot(dx, dy).alias("meters"), x.cast("double").alias("ax"), y.cast("double").alias("ay"), (x + dx).cast("double").alias("bx"), (y + dy).cast("double").alias("by"), F.lit(True).alias("path"), F.when(F.col("h") % 5 == 0, 1).otherwise(0).alias("level"))
    return s.unionByName(stub)


LANES_SQL = STREETS_SQL + """, lane AS (SELECT edge, a, b, meters, ax, ay, bx, yy, path, 0 AS level FROM street UNION ALL SELECT -k - 1, k, -k - 1, sqrt(pow(h % 71 - 20, 2) + pow((h // 128) % 29 + 1, 2)), x, y, x + (h % 71 - 20), y + ((h // 128) % 29 + 1), true, CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END FROM spot WHERE h % 2 = 0)"""
