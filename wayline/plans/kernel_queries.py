"""Queries for path reduction, graphs, exchange formats and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import matching as M
from ..operators import reduce as P
from ..sources import exchange as E
from ..sources.lenses import FIX_SQL, LAP_SQL, RIDE_SQL, STEP_SQL, fix, lap, read, ride
from ..sources.shared import shared_dir
from ..streaming import best_pace, live


def _reducer(algorithm: str):
    return lambda spark, d: P.reduce_rides(fix(spark, d), algorithm)


def reduce_compare(spark, d):
    return P.compare(fix(spark, d)).select("ride_id", "algorithm", "n", "n_kept", *[F.round(s, 4).alias(s) for s in P.SCORES])


def _edges(spark, d):
    """Customers of one nation and segment in a row, and orders' customers: a sparse graph of the tables."""
    c = read(spark, d, "customer")
    return c.selectExpr("c_custkey AS a", "c_custkey + 1 + c_custkey % 7 AS b", "1.0D + c_custkey % 5 AS cost", "c_custkey % 3 = 0 OR c_custkey % 11 = 0 AS ok").where("ok").drop("ok")


def connected_components(spark, d):
    n = read(spark, d, "customer").selectExpr("c_custkey AS id")
    e = _edges(spark, d).join(n.withColumnRenamed("id", "b"), "b")
    return G.components(n, e)


def _path_edges(spark, d):
    """The sparse graph, a way ten nodes on and one to the node of twice the number."""
    c = read(spark, d, "customer")
    return _edges(spark, d).unionByName(c.selectExpr("c_custkey AS a", "c_custkey + 10 AS b", "7.0D AS cost")).unionByName(c.selectExpr("c_custkey AS a", "c_custkey * 2 AS b", "3.0D AS cost"))


def shortest_path(spark, d):
    s = spark.createDataFrame([(1,), (2,), (3,)], "source long")
    return G.shortest_paths(_path_edges(spark, d), s, rounds=1 << 40)


def graph_junctions(spark, d):
    return G.junctions(_edges(spark, d), 2)


def way_costs(spark, d):
    w = read(spark, d, "part").selectExpr("p_partkey AS way_id", "split(p_type, ' ')[0] AS class", "IF(p_size % 4 = 0, 'unpaved', 'paved') AS surface", "p_size % 3 = 0 AS oneway", "IF(p_size % 10 = 0, 'private', NULL) AS access")
    profile = w.groupBy("class").agg((F.length("class") / 10.0).alias("factor")).where("length(class) > 5")
    return G.way_costs(w, profile).select("way_id", F.round("forward", 4).alias("forward"), F.round("backward", 4).alias("backward"))


def gpx_roundtrip(spark, d):
    back = E.read_gpx(E.gpx(fix(spark, d)))
    return back.select("ride_id", "seq", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.round("altitude", 1).alias("altitude"), "t_ms")


def backup_roundtrip(spark, d):
    r = ride(spark, d).select("id", "activity", F.round("total_distance", 3).alias("total_distance"), "start_ms", (F.col("id") % 8).alias("shard"))
    return E.read_backup(E.backup(r), "id bigint, activity string, total_distance double, start_ms bigint")


def share_link_roundtrip(spark, d):
    """Rides as links of at most 100 points, of near the same number each, put together again."""
    n, w = F.count("*").over(Window.partitionBy("ride_id")), Window.partitionBy("ride_id", "part").orderBy("seq")
    f = fix(spark, d).withColumn("n", n).withColumn("part", F.floor(F.col("seq") * F.ceil(F.col("n") / 100) / F.col("n")))
    f = f.where("n > 1").select("lat", "lng", "seq", (F.col("ride_id") * 100_000 + F.col("part")).alias("link_id"), (F.col("seq") - F.min("seq").over(w)).alias("at"), F.min("seq").over(w).alias("first"))
    links = E.share_text(f.select(F.col("link_id").alias("ride_id"), F.col("at").alias("seq"), "lat", "lng"))
    back = E.read_share_text(links).join(f.select(F.col("link_id").alias("ride_id"), "first").distinct(), "ride_id")
    return back.select(F.floor(F.col("ride_id") / 100_000).alias("ride_id"), (F.col("seq") + F.col("first")).alias("seq"), F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


def live_ride_totals(spark, d):
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    f = fix(spark, d).select("ride_id", "seq", "lat", "lng", "t_ms", "speed")
    out = live.run_to_table(live.live_totals(live.replay(spark, f, f"{base}/in")), f"{base}/out", f"{base}/state")
    return out.select("ride_id", "n", F.round("distance_m", 4).alias("distance_m"), F.round("max_speed", 4).alias("max_speed"), "last_ms", "silent")


def incremental_best_pace(spark, d):
    base = f"{shared_dir(spark)}/best-{uuid.uuid4().hex}"
    laps = lap(spark, d)
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laps.repartition(files, "ride_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(laps.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{base}/in")  # three batches
    best_pace.maintain(stream, f"{base}/out", f"{base}/state")
    return best_pace.current(spark, f"{base}/out").select("section_id", "direction", "passes", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "best", "best_ride_id")


def sticky_match(spark, d):
    """Fixes against the lines of a 40 m grid."""
    p = fix(spark, d).select("ride_id", "seq", ((F.col("lng") + 105) * 85_000).alias("x"), ((F.col("lat") - 40) * 110_540).alias("y"))
    lines = spark.range(0, 60).selectExpr("id AS segment_id", "IF(id < 30, id * 40D - 200, -200D) AS ax", "IF(id < 30, -200D, (id - 30) * 40D - 200) AS ay", "IF(id < 30, id * 40D - 200, 1000D) AS bx", "IF(id < 30, 1000D, (id - 30) * 40D - 200) AS by")
    return M.ridden_sections(M.match(p, lines)).select("ride_id", F.col("run").cast("long"), "segment_id", "first_seq", "last_seq")


_GREEDY = ", k AS (SELECT ride_id, seq, t_ms, (lng - first_value(lng) OVER w) * 111320 * cos(radians(avg(lat) OVER (PARTITION BY ride_id))) AS x, (lat - first_value(lat) OVER w) * 110540 AS y, max(seq) OVER (PARTITION BY ride_id) AS last FROM fix WINDOW w AS (PARTITION BY ride_id ORDER BY seq)), g AS (SELECT ride_id, seq, last, t_ms AS t, x AS gx, y AS gy, true AS keep FROM k WHERE seq = 0 UNION ALL SELECT k.ride_id, k.seq, k.last, CASE WHEN {test} THEN k.t_ms ELSE g.t END, CASE WHEN {test} THEN k.x ELSE g.gx END, CASE WHEN {test} THEN k.y ELSE g.gy END, {test} FROM g JOIN k ON k.ride_id = g.ride_id AND k.seq = g.seq + 1) SELECT ride_id, seq FROM g WHERE keep OR seq = last"
_EDGE = "e AS (SELECT c_custkey AS a, c_custkey + 1 + c_custkey % 7 AS b, 1::DOUBLE + c_custkey % 5 AS cost FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 11 = 0)"

QUERIES = {
    **{f"reduce_{a}": (_reducer(a), None) for a in P.REGISTRY},
    "reduce_spacing": (_reducer("spacing"), "WITH RECURSIVE " + FIX_SQL + _GREEDY.format(test="sqrt(pow(k.x - g.gx, 2) + pow(k.y - g.gy, 2)) >= 10")),
    "reduce_interval": (_reducer("interval"), "WITH RECURSIVE " + FIX_SQL + _GREEDY.format(test="k.t_ms - g.t >= 5000")),
    "reduce_compare": (reduce_compare, None),
    "connected_components": (connected_components, "WITH RECURSIVE " + _EDGE + ", n AS (SELECT c_custkey AS id FROM customer), u AS (SELECT a, b FROM e WHERE b IN (SELECT id FROM n) UNION SELECT b, a FROM e WHERE b IN (SELECT id FROM n)), r(a, b) AS (SELECT id, id FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a"),
    # costs are not negative, so paths that cost over 150, more than any shortest one, need no further step
    "shortest_path": (shortest_path, "WITH RECURSIVE " + _EDGE + ", f AS (SELECT * FROM e UNION ALL SELECT c_custkey, c_custkey + 10, 7 FROM customer UNION ALL SELECT c_custkey, c_custkey * 2, 3 FROM customer), r(source, node, cost) AS (SELECT i, i, 0::DOUBLE FROM range(1, 4) t(i) UNION SELECT r.source, f.b, r.cost + f.cost FROM r JOIN f ON f.a = r.node WHERE r.cost + f.cost <= 150) SELECT source, node, min(cost) AS cost FROM r GROUP BY ALL"),
    "graph_junctions": (graph_junctions, "WITH " + _EDGE + ", u AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT a AS id, count(DISTINCT b) AS degree FROM u GROUP BY a HAVING count(DISTINCT b) >= 2"),
    "way_costs": (way_costs, "WITH w AS (SELECT p_partkey AS way_id, split_part(p_type, ' ', 1) AS class, p_size FROM part), x AS (SELECT way_id, CASE WHEN length(class) > 5 AND p_size % 10 <> 0 THEN length(class) / 10 * CASE WHEN p_size % 4 = 0 THEN 1.5::DOUBLE ELSE 1::DOUBLE END END AS f, p_size FROM w) SELECT way_id, round(f, 4) AS forward, round(f * CASE WHEN p_size % 3 = 0 THEN 5 ELSE 1 END, 4) AS backward FROM x"),
    "gpx_roundtrip": (gpx_roundtrip, "WITH " + FIX_SQL + "SELECT ride_id, seq, round(lat, 6) AS lat, round(lng, 6) AS lng, round(altitude, 1) AS altitude, t_ms FROM fix"),
    "backup_roundtrip": (backup_roundtrip, "WITH " + RIDE_SQL + "SELECT id, activity, round(total_distance, 3) AS total_distance, start_ms FROM ride"),
    "share_link_roundtrip": (share_link_roundtrip, "WITH " + FIX_SQL + "SELECT ride_id, seq, round(floor(lat * 100000 + 0.5) / 100000, 5) AS lat, round(floor(lng * 100000 + 0.5) / 100000, 5) AS lng FROM fix QUALIFY count(*) OVER (PARTITION BY ride_id) > 1"),
    "incremental_best_pace": (incremental_best_pace, "WITH " + LAP_SQL + "SELECT section_id, direction, count(*) AS passes, strftime(min(ride_date), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(ride_date), '%Y-%m-%d %H:%M:%S') AS last_date, max(speed) AS best, first(ride_id ORDER BY speed DESC, ride_date, ride_id) AS best_ride_id FROM lap GROUP BY ALL"),
    "sticky_match": (sticky_match, None),
    "live_ride_totals": (live_ride_totals, "WITH " + STEP_SQL + "SELECT ride_id, count(*) AS n, round(sum(step_m), 4) AS distance_m, round(max(speed), 4) AS max_speed, max(t_ms) AS last_ms, sum(coalesce((t_ms - pt > 3500)::INT, 0))::BIGINT AS silent FROM step1 GROUP BY ride_id"),
}
