"""Queries for routes to one goal, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ridden as N
from ..operators import routing as T
from ..operators.graph import written
from ..sources.lenses import STREETS_SQL, TRACK_POINTS_SQL, TRACK_SQL, streets, track, track_points


def _network(spark, d):
    """Streets with costs by direction: lesser roads cost more, some are one-way."""
    e = streets(spark, d)
    cost = F.col("meters") * (F.lit(0.8) + F.col("rank") * 0.2)
    return written(e.withColumns({"forward": cost, "backward": cost * F.when(F.col("edge") % 9 == 0, 5.0).otherwise(1.0)}))


def _home(spark, d):
    """From where each ride's last fix on a street lies to where its first one does; and the streets of its fixes."""
    e = _network(spark, d)
    p = track_points(track(spark, d)).select("ride_id", "seq", "x", "y")
    on = written(N.on_chains(p, e.selectExpr("*", "edge AS chain", "0D AS along", "true AS forward_").drop("forward").withColumnRenamed("forward_", "forward"), slack=-1.0).select("ride_id", "seq", "edge", "at"))
    ends = on.groupBy(F.col("ride_id").alias("request")).agg(F.max_by(F.struct("edge", "at"), "seq").alias("s"), F.min_by(F.struct("edge", "at"), "seq").alias("g"))
    asked = ends.select("request", F.col("s.edge").alias("edge1"), F.col("s.at").alias("at1"), F.lit(5.0).alias("off"), F.col("g.edge").alias("edge2"), F.col("g.at").alias("at2"))
    return written(asked), e, on


def _costs(routes):
    return routes.select("request", F.round("cost", 4).alias("cost"), F.round("meters", 4).alias("meters"), F.size("edges").alias("edges"))


def routes_home(spark, d):
    asked, e, _ = _home(spark, d)
    return _costs(T.routes(asked, T.overlay(e, 500.0)))


def routes_not_retraced(spark, d):
    """As before, but the streets that the ride has been on cost six times as much."""
    asked, e, on = _home(spark, d)
    ridden = on.select(F.col("ride_id").alias("request"), "edge").distinct().withColumns({"forward": F.lit(6.0), "backward": F.lit(6.0)})
    return _costs(T.routes(asked, T.overlay(e, 500.0), ridden))


def leg_routes(spark, d):
    """Legs between the places where fixes ten apart lie, each over the tiles of its own corridor."""
    _, e, on = _home(spark, d)
    w = Window.partitionBy("ride_id").orderBy("seq")
    every = on.withColumn("k", F.row_number().over(w) - 1).where("k % 10 = 0")
    legs = every.withColumns({"edge2": F.lead("edge").over(w), "at2": F.lead("at").over(w)}).where("edge2 IS NOT NULL")
    asked = legs.select((F.col("ride_id") * 100_000 + F.col("seq")).alias("request"), F.col("edge").alias("edge1"), F.col("at").alias("at1"), F.lit(0.0).alias("off"), "edge2", "at2")
    out = T.routes_in_corridors(asked, e, 500.0)
    return out.select("request", F.round("cost", 4).alias("cost"), F.round("meters", 4).alias("meters"), "edges")


def _legs_sql() -> str:
    """Each leg's graph for itself: the edges whose box touches the tiles of its box."""
    tile = lambda lo, hi, c: f"floor(greatest({lo}, {hi}) / 500) >= floor((least({c}1, {c}2) - 0.3 * far12) / 500) AND floor(least({lo}, {hi}) / 500) <= floor((greatest({c}1, {c}2) + 0.3 * far12) / 500)"
    return f"""WITH RECURSIVE {TRACK_SQL}, {TRACK_POINTS_SQL}, {STREETS_SQL}, {_NEAREST}
ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1 AS n FROM m0) WHERE n % 10 = 0),
q0 AS (SELECT ride_id * 100000 + seq AS request, edge AS e1, a AS a1, b AS b1, t AS t1, meters AS m1, fw AS fw1, bw AS bw1, ax + t * (bx - ax) AS x1, ay + t * (yy - ay) AS y1, lead(edge) OVER w AS e2, lead(a) OVER w AS a2, lead(b) OVER w AS b2, lead(t) OVER w AS t2, lead(meters) OVER w AS m2, lead(fw) OVER w AS fw2, lead(bw) OVER w AS bw2, lead(ax + t * (bx - ax)) OVER w AS x2, lead(ay + t * (yy - ay)) OVER w AS y2 FROM ten WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
q AS MATERIALIZED (SELECT *, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS far12 FROM q0 WHERE e2 IS NOT NULL),
half AS MATERIALIZED (SELECT request, s.* FROM q JOIN (SELECT edge, a AS u, b AS v, fw AS c, meters AS m, ax, ay, bx, yy FROM net UNION ALL SELECT edge, b, a, bw, meters, ax, ay, bx, yy FROM net) s ON {tile('ax', 'bx', 'x')} AND {tile('ay', 'yy', 'y')} WHERE e1 <> e2),
{_ROUNDS.format(first='0', f1='1', on='h.request = r.request AND h.u = r.node', f2='1')}
SELECT request, round(min(cost), 4) AS cost, round(arg_min(meters, cost), 4) AS meters, arg_min(edges, cost) AS edges FROM e GROUP BY request
UNION ALL SELECT request, round(abs(t1 - t2) * m1, 4), round(abs(t1 - t2) * m1, 4), 1 FROM q WHERE e1 = e2
"""


_NEAREST = """
net AS (SELECT *, meters * (0.8::DOUBLE + rank * 0.2::DOUBLE) AS fw, meters * (0.8::DOUBLE + rank * 0.2::DOUBLE) * CASE WHEN edge % 9 = 0 THEN 5 ELSE 1 END AS bw FROM street),
at0 AS (SELECT p.ride_id, p.seq, p.x AS px, p.y AS py, s.*, greatest(0, least(1, coalesce(((p.x - ax) * (bx - ax) + (p.y - ay) * (yy - ay)) / nullif(pow(bx - ax, 2) + pow(yy - ay, 2), 0), 0))) AS t
  FROM point p JOIN net s ON p.x BETWEEN least(ax, bx) - 25 AND greatest(ax, bx) + 25 AND p.y BETWEEN least(ay, yy) - 25 AND greatest(ay, yy) + 25),
at1 AS (SELECT *, sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (yy - ay), 2)) AS far FROM at0),
m0 AS MATERIALIZED (SELECT * FROM at1 WHERE far <= CASE WHEN path THEN 20 ELSE 25 END QUALIFY row_number() OVER (PARTITION BY ride_id, seq ORDER BY far, path, edge) = 1),"""
# costs by rounds over all edges; metres and edges are carried along the cheapest way
_ROUNDS = """r(request, node, cost, meters, edges) USING KEY (request, node) AS (
  SELECT request, node, min(cost), arg_min(meters, cost), 1::BIGINT FROM (SELECT request, b1 AS node, {first} + (1 - t1) * fw1 * {f1} AS cost, (1 - t1) * m1 AS meters FROM q WHERE e1 <> e2 UNION ALL SELECT request, a1, {first} + t1 * bw1 * {f1}, t1 * m1 FROM q WHERE e1 <> e2) GROUP BY request, node
  UNION
  SELECT request, v, min(cost), arg_min(meters, cost), arg_min(edges, cost) FROM (SELECT r.request, h.v, r.cost + h.c * {f2} AS cost, r.meters + h.m AS meters, r.edges + 1 AS edges FROM r JOIN half h ON {on}) n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r o WHERE o.request = n.request AND o.node = n.v AND o.cost <= n.cost)
    AND NOT EXISTS (SELECT 1 FROM recurring.r g JOIN q ON q.request = g.request AND g.node = q.a2 WHERE g.request = n.request AND g.cost + t2 * fw2 < n.cost) GROUP BY request, v),
e AS (SELECT q.request, r.cost + t2 * fw2 AS cost, r.meters + t2 * m2 AS meters, r.edges + 1 AS edges FROM q JOIN r ON r.request = q.request AND r.node = a2 UNION ALL SELECT q.request, r.cost + (1 - t2) * bw2, r.meters + (1 - t2) * m2, r.edges + 1 FROM q JOIN r ON r.request = q.request AND r.node = b2)"""


def _sql(retraced: bool) -> str:
    more = "CASE WHEN EXISTS (SELECT 1 FROM ridden x WHERE x.request = {r} AND x.edge = {e}) THEN 6 ELSE 1 END" if retraced else "1"
    return f"""WITH RECURSIVE {TRACK_SQL}, {TRACK_POINTS_SQL}, {STREETS_SQL}, {_NEAREST}
ridden AS MATERIALIZED (SELECT DISTINCT ride_id AS request, edge FROM m0),
s AS (SELECT ride_id AS request, edge AS e1, a AS a1, b AS b1, t AS t1, meters AS m1, fw AS fw1, bw AS bw1 FROM m0 QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY seq DESC) = 1),
g AS (SELECT ride_id AS request, edge AS e2, a AS a2, b AS b2, t AS t2, meters AS m2, fw AS fw2, bw AS bw2 FROM m0 QUALIFY row_number() OVER (PARTITION BY ride_id ORDER BY seq) = 1),
q AS MATERIALIZED (SELECT * FROM s JOIN g USING (request)),
half AS MATERIALIZED (SELECT edge, a AS u, b AS v, fw AS c, meters AS m FROM net UNION ALL SELECT edge, b, a, bw, meters FROM net),
{_ROUNDS.format(first='5', f1=more.format(r='request', e='e1'), on='h.u = r.node', f2=more.format(r='r.request', e='h.edge'))}
SELECT request, round(min(cost), 4) AS cost, round(arg_min(meters, cost), 4) AS meters, arg_min(edges, cost)::INT AS edges FROM e GROUP BY request
UNION ALL SELECT request, round(5 + abs(t1 - t2) * m1, 4), round(abs(t1 - t2) * m1, 4), 1 FROM q WHERE e1 = e2
"""


QUERIES = {"routes_home": (routes_home, _sql(False)), "routes_not_retraced": (routes_not_retraced, _sql(True)), "leg_routes": (leg_routes, _legs_sql())}
