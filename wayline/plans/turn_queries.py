"""Turn-by-turn steps along the tracks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import turns as U
from ..sources.lenses import STREETS_SQL, TRACK_POINTS_SQL, TRACK_SQL, streets, track, track_points


def turn_steps(spark, d):
    """The tracks as routes among the streets; every other row of streets has a name."""
    p = track_points(track(spark, d)).select(F.col("ride_id").alias("route"), F.col("seq").alias("i"), "x", (-F.col("y")).alias("y"))
    e = streets(spark, d)
    name = F.when((F.col("edge") % 2 == 0) & (F.expr("a div 40") % 2 == 0), F.concat(F.lit("Row "), F.expr("a div 40"))).when((F.col("edge") % 2 == 1) & (F.col("a") % 3 > 0), F.concat(F.lit("Line "), F.col("a") % 40))
    ways = e.select("ax", (-F.col("ay")).alias("ay"), "bx", (-F.col("by")).alias("by"), name.alias("name"), F.when(name.isNull() & F.col("path"), "path").alias("kind"))
    nodes = e.select(F.col("a").alias("node"), F.col("ax").alias("x"), (-F.col("ay")).alias("y")).unionByName(e.select(F.col("b").alias("node"), F.col("bx").alias("x"), (-F.col("by")).alias("y"))).distinct()
    s = U.turn_steps(p, nodes, e.select("a", "b"), ways, 20.0)
    return s.withColumn("said", U.instruction(F.col("turn"), F.col("name"), F.col("kind"), F.col("stay"))).select("route", "i", F.round("along", 4).alias("along"), "turn", F.round("angle", 4).alias("angle"), "name", "kind", "stay", "said")


def _at(d: str) -> str:
    """The place at a distance along route q.route."""
    return f"""(SELECT CASE WHEN {d} <= 0 THEN {{'x': arg_min(l.x, l.i), 'y': arg_min(l.y, l.i)}} WHEN {d} > max(l.along) THEN {{'x': arg_max(l.x, l.i), 'y': arg_max(l.y, l.i)}}
   ELSE arg_min({{'x': l.px + (l.x - l.px) * ({d} - l.palong) / nullif(l.along - l.palong, 0), 'y': l.py + (l.y - l.py) * ({d} - l.palong) / nullif(l.along - l.palong, 0)}}, l.i) FILTER (l.palong IS NOT NULL AND l.along >= {d}) END FROM vert l WHERE l.route = q.route)"""


def _named(what: str, p: str, h: str) -> str:
    off = f"abs(degrees(atan2(bx - ax, -(yy - ay))) - {h})"
    axis = f"least({off} % 180, 180 - {off} % 180)"
    return f"""{what} AS (SELECT route, cluster, arg_min(name, far) FILTER (name IS NOT NULL) AS name, arg_min(kind, far) FILTER (name IS NULL AND kind IS NOT NULL) AS kind FROM (
  SELECT *, sqrt(pow({p}.x - ax - u * (bx - ax), 2) + pow({p}.y - ay - u * (yy - ay), 2)) AS far FROM (
    SELECT q.*, w.*, greatest(0, least(1, (({p}.x - ax) * (bx - ax) + ({p}.y - ay) * (yy - ay)) / (pow(bx - ax, 2) + pow(yy - ay, 2)))) AS u FROM turned q JOIN way w
      ON {p}.x BETWEEN least(ax, bx) - 12 AND greatest(ax, bx) + 12 AND {p}.y BETWEEN least(ay, yy) - 12 AND greatest(ay, yy) + 12 WHERE {axis} <= 35)) WHERE far < 12 GROUP BY route, cluster)"""


STEPS_SQL = f"""WITH {TRACK_SQL}, {TRACK_POINTS_SQL}, {STREETS_SQL},
way AS (SELECT ax, -ay AS ay, bx, -yy AS yy, name, CASE WHEN name IS NULL AND path THEN 'path' END AS kind FROM (SELECT *, CASE WHEN edge % 2 = 0 AND (a // 40) % 2 = 0 THEN 'Row ' || (a // 40) WHEN edge % 2 = 1 AND a % 3 > 0 THEN 'Line ' || (a % 40) END AS name FROM street)),
line0 AS (SELECT ride_id AS route, seq AS i, x, -y AS y, lag(x) OVER w AS px, lag(-y) OVER w AS py FROM point WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
line1 AS (SELECT *, sum(coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0)) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS along FROM line0),
vert AS MATERIALIZED (SELECT *, lag(along) OVER (PARTITION BY route ORDER BY i) AS palong, max(i) OVER (PARTITION BY route) AS last FROM line1),
nb AS (SELECT a AS node, b AS other, ax AS x, -ay AS y FROM street UNION SELECT b, a, bx, -yy FROM street),
junction AS (SELECT node, x, y FROM nb GROUP BY ALL HAVING count(DISTINCT other) >= 3),
near AS (SELECT route, i, node, sqrt(pow(j.x - l.x, 2) + pow(j.y - l.y, 2)) AS far FROM vert l JOIN junction j ON j.x BETWEEN l.x - 20 AND l.x + 20 AND j.y BETWEEN l.y - 20 AND l.y + 20 WHERE i > 0 AND i < last),
met0 AS (SELECT *, lag(node) OVER (PARTITION BY route ORDER BY i) AS was FROM (SELECT * FROM near WHERE far <= 20 QUALIFY row_number() OVER (PARTITION BY route, i ORDER BY far, node) = 1)),
met AS (SELECT *, sum(coalesce(node <> was, false)::INT) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS row_ FROM met0),
one AS (SELECT m.route, l.i, l.x, l.y, l.along FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY route, row_ ORDER BY far, i) = 1) m JOIN vert l USING (route, i)),
cl0 AS (SELECT *, coalesce(along - lag(along) OVER (PARTITION BY route ORDER BY i) >= 20, false)::INT AS new FROM one),
cl AS (SELECT *, sum(new) OVER (PARTITION BY route ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM cl0),
q AS MATERIALIZED (SELECT route, cluster, min(i) AS i, arg_min(x, i) AS fx, arg_min(y, i) AS fy, arg_min(along, i) AS fa, arg_max(x, i) AS lx, arg_max(y, i) AS ly, arg_max(along, i) AS la FROM cl GROUP BY route, cluster),
placed AS MATERIALIZED (SELECT *, {_at('(q.fa - 15)')} AS p_in, {_at('(q.la + 15)')} AS p_out, {_at('(q.fa - 20)')} AS p_from, {_at('(q.la + 20)')} AS p_onto FROM q WHERE fa >= 5),
hd AS (SELECT *, degrees(atan2(fx - p_in.x, -(fy - p_in.y))) AS h_in, degrees(atan2(p_out.x - lx, -(p_out.y - ly))) AS h_out FROM placed),
an AS (SELECT *, h_out - h_in - 360 * floor((h_out - h_in) / 360) AS a0 FROM hd),
turned AS MATERIALIZED (SELECT *, CASE WHEN a0 > 180 THEN a0 - 360 ELSE a0 END AS angle FROM an WHERE abs(CASE WHEN a0 > 180 THEN a0 - 360 ELSE a0 END) >= 30),
{_named('onto', 'p_onto', 'h_out')}, {_named('frm', 'p_from', 'h_in')},
steps AS (SELECT t.route, t.i, t.fa AS along, abs(angle) AS size, angle, o.name, o.kind, coalesce(f.name = o.name, false) AS stay FROM turned t LEFT JOIN onto o USING (route, cluster) LEFT JOIN frm f USING (route, cluster)),
named AS (SELECT route, i, along, angle, name, kind, stay, CASE WHEN size >= 165 THEN 'uturn' WHEN size >= 135 THEN 'sharp-' || side WHEN size >= 60 THEN side ELSE 'slight-' || side END AS turn,
  CASE WHEN size >= 165 THEN 'Make a U-turn' WHEN size >= 135 THEN 'Sharp ' || side WHEN size >= 60 THEN 'Turn ' || side ELSE 'Bear ' || side END AS said FROM (SELECT *, CASE WHEN angle > 0 THEN 'right' ELSE 'left' END AS side FROM steps) WHERE NOT stay OR size >= 60)
SELECT route, i, round(along, 4) AS along, turn, round(angle, 4) AS angle, name, kind, stay, said || CASE WHEN coalesce(name, kind) IS NULL THEN '' ELSE CASE WHEN stay THEN ' to stay on ' ELSE ' onto ' END || coalesce(name, 'the ' || kind) END AS said FROM named
UNION ALL SELECT route, i, round(along, 4), 'arrive', NULL, NULL, NULL, false, NULL FROM vert WHERE i = last
"""

QUERIES = {"turn_steps": (turn_steps, STEPS_SQL)}
