"""Queries for chains of the road network, their sections, grades and twins, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import roads as R
from ..sources.lenses import FIX_SQL, fix, read


def _edges(spark, d):
    """Streets of 29 nodes, some of them loops, some with a piece of a higher rank, with side ways at every seventh."""
    c = read(spark, d, "customer").selectExpr("c_custkey AS k")
    street = c.where("NOT (k % 29 = 0 AND k % 58 <> 0)").selectExpr("k AS edge", "k AS a", "IF(k % 58 = 0, k - 28, k + 1) AS b", "IF(((k - 1) div 29) % 3 <> 1 AND k % 11 = 0, 2, 1) AS rank", "20D + k % 60 AS meters")
    side = c.where("k % 7 = 3").selectExpr("-k AS edge", "k AS a", "-k AS b", "3 AS rank", "15D + k % 40 AS meters")
    x, y = "double(abs({0}) * 7919 % 2003)", "double(abs({0}) * 104729 % 1999)"
    return street.unionByName(side).selectExpr("*", *[f"{p.format(n)} AS {n}{axis}" for n in "ab" for p, axis in ((x, "x"), (y, "y"))])


def road_chains(spark, d):
    return R.chains(_edges(spark, d)).select("edge", "chain", "total", "along", "forward", "k")


def _cuts(spark, d):
    e = _edges(spark, d)
    c = R.written(R.chains(e))
    return R.section_cuts(c.select("chain", "total").distinct(), R.side_junctions(c, e))


def section_cuts(spark, d):
    return _cuts(spark, d).select("chain", "n", F.round("at", 6).alias("at"))


def section_grades(spark, d):
    """Every section between two cuts, with made-up heights of which some are missing."""
    c = R.written(_cuts(spark, d))
    w = Window.partitionBy("chain").orderBy("n")
    point = lambda n: F.concat_ws(":", "chain", n)
    s = c.withColumn("meters", F.lead("at").over(w) - F.col("at")).where("meters IS NOT NULL")
    s = s.select("chain", "n", "meters", point(F.col("n")).alias("start"), point(F.col("n") + 1).alias("stop"))
    h = c.where("(abs(chain) + n) % 13 <> 0").select(point(F.col("n")).alias("point"), F.expr("double((abs(chain) * 37 + n * 11) % 20)").alias("height"))
    return R.section_grades(s, h).select("chain", "n", F.round("meters", 6).alias("meters"), F.round("grade", 6).alias("grade"))


def section_twins(spark, d):
    """Orders as sections, two by two within metres of one another, most of them ridden the other way."""
    k = "(o_orderkey div 2)"
    o = read(spark, d, "orders").selectExpr("o_orderkey AS section", f"47D + {k} * 7919 % 10007 * 0.0001D + o_orderkey % 5 * 0.00001D AS lat", f"8D + {k} * 104729 % 10009 * 0.0001D AS lng", f"double(({k} * 17 + o_orderkey % 2 * 180 + o_orderkey % 7 * 9) % 360) AS bearing", "o_orderkey % 9 = 0 AS both_ways")
    return R.section_twins(o)


def graph_build(spark, d):
    """Orders as vertices of their customers' ways, on a grid so wide that only equal places are one node."""
    o = read(spark, d, "orders").selectExpr("o_orderkey AS id", "o_custkey AS way", "o_orderkey AS i", "(o_orderkey * 7919) % 41 * 2D AS x", "(o_orderkey * 104729) % 43 * 2D AS y")
    w = read(spark, d, "customer").selectExpr("c_custkey AS way", "1D + c_custkey % 3 AS forward", "1D + c_custkey % 5 AS backward", "int(c_custkey % 4) AS rank")
    g = R.road_graph(o, w, 2.5)
    return g.select("way", "i", "a", "b", *[F.round(c, 4).alias(c) for c in ("meters", "forward", "backward")], "rank")


def track_edges(spark, d):
    """Fixes as tracks, in steps of ten metres, among roads that cross them."""
    f = fix(spark, d).selectExpr("ride_id", "seq", "-(ride_id * 100000 + seq) - 1 AS id", "seq * 10D AS x", "double(seq * seq % 23 + ride_id % 7 * 50) AS y")
    c = read(spark, d, "customer").selectExpr("c_custkey AS segment_id", "c_custkey AS a", "c_custkey + 1 AS b", "c_custkey % 97 * 11.25D AS ax", "c_custkey % 41 * 9.5D AS ay")
    r = c.withColumns({"bx": F.col("ax") + 30 - F.col("segment_id") % 7 * 10, "by": F.col("ay") + 25.5})
    return R.track_edges(f, r).select("a", "b", F.round("meters", 4).alias("meters"), F.round("cost", 4).alias("cost"), "kind")


_CHAINS = """WITH RECURSIVE e AS (SELECT c_custkey AS edge, c_custkey AS a, CASE WHEN c_custkey % 58 = 0 THEN c_custkey - 28 ELSE c_custkey + 1 END AS b, CASE WHEN ((c_custkey - 1) // 29) % 3 <> 1 AND c_custkey % 11 = 0 THEN 2 ELSE 1 END AS rank, (20 + c_custkey % 60)::DOUBLE AS meters FROM customer WHERE NOT (c_custkey % 29 = 0 AND c_custkey % 58 <> 0)
  UNION ALL SELECT -c_custkey, c_custkey, -c_custkey, 3, (15 + c_custkey % 40)::DOUBLE FROM customer WHERE c_custkey % 7 = 3),
h AS (SELECT edge, 0 AS side, a AS tail, b AS head, rank, meters FROM e UNION ALL SELECT edge, 1, b, a, rank, meters FROM e),
ok AS (SELECT p.head, p.rank FROM (SELECT DISTINCT head, rank FROM h) p JOIN h o ON o.head = p.head AND o.rank <= p.rank GROUP BY ALL HAVING count(*) = 2 AND min(o.rank) = p.rank),
s AS (SELECT p.edge, p.side, q.edge AS ne, 1 - q.side AS ns FROM h p JOIN ok USING (head, rank) JOIN h q ON p.head = q.head AND p.rank = q.rank AND p.edge <> q.edge),
w(e0, edge, side) AS (SELECT edge, edge, side FROM h WHERE side = 0 UNION SELECT w.e0, s.ne, s.ns FROM w JOIN s USING (edge, side)),
lp AS (SELECT e0 FROM w JOIN s USING (edge, side) WHERE ne = e0 AND ns = 0),
st AS (SELECT edge, side FROM h ANTI JOIN (SELECT ne AS edge, ns AS side FROM s) USING (edge, side) UNION ALL SELECT e0, 0 FROM lp WHERE e0 = (SELECT min(edge) FROM w WHERE w.e0 = lp.e0)),
r(fe, fs, edge, side, k, along) AS (SELECT edge, side, edge, side, 0, 0::DOUBLE FROM st UNION ALL SELECT r.fe, r.fs, s.ne, s.ns, r.k + 1, r.along + h.meters FROM r JOIN s USING (edge, side) JOIN h ON h.edge = r.edge AND h.side = r.side WHERE NOT (s.ne = r.fe AND s.ns = r.fs)),
v AS (SELECT fe, fs, min(r.edge) AS chain, arg_min(tail, k) AS t, arg_max(head, k) AS l, arg_max(r.edge, k) AS le, arg_max(r.side, k) AS ls, max(along + meters) AS total FROM r JOIN h USING (edge, side) GROUP BY ALL),
vx AS (SELECT *, abs(t) * 7919 % 2003 AS tx, abs(t) * 104729 % 1999 AS ty, abs(l) * 7919 % 2003 AS hx, abs(l) * 104729 % 1999 AS hy FROM v),
c AS (SELECT r.edge, chain, total, along, r.side = 0 AS forward, tail, k::BIGINT AS k FROM vx JOIN r USING (fe, fs) JOIN h ON h.edge = r.edge AND h.side = r.side WHERE tx < hx OR (tx = hx AND (ty > hy OR (ty = hy AND (fe < le OR (fe = le AND fs <= 1 - ls))))))"""
_CUTS = _CHAINS + """,
j AS (SELECT chain, along AS p FROM c WHERE k > 0 AND tail IN (SELECT head FROM h GROUP BY head HAVING count(*) > 2)), tot AS (SELECT DISTINCT chain, total FROM c),
g(chain, total, pos, n) AS (SELECT chain, total, 0::DOUBLE, 0::BIGINT FROM tot UNION ALL SELECT chain, total, nx, n + 1 FROM (SELECT g.chain, g.total, g.n, coalesce(arg_min(j.p, {'d': abs(j.p - g.pos - 100), 'a': j.p}), CASE WHEN g.total - g.pos > 150 THEN g.pos + (g.total - g.pos) / floor((g.total - g.pos) / 100 + 0.5) END) AS nx FROM g LEFT JOIN j ON j.chain = g.chain AND j.p >= g.pos + 40 AND j.p <= least(g.pos + 150, g.total - 40) GROUP BY g.chain, g.total, g.pos, g.n) q WHERE nx IS NOT NULL),
cuts AS (SELECT chain, n, pos FROM g UNION ALL SELECT chain, max(n) + 1, total FROM g GROUP BY chain, total)"""

QUERIES = {
    "road_chains": (road_chains, _CHAINS + " SELECT edge, chain, total, along, forward, k FROM c"),
    "section_cuts": (section_cuts, _CUTS + " SELECT chain, n, round(pos, 6) AS \"at\" FROM cuts"),
    "section_grades": (section_grades, _CUTS + ", hh AS (SELECT chain, n, CASE WHEN (abs(chain) + n) % 13 <> 0 THEN (abs(chain) * 37 + n * 11) % 20 END AS hgt, pos FROM cuts) SELECT a.chain, a.n, round(b.pos - a.pos, 6) AS meters, round((b.hgt - a.hgt) / (b.pos - a.pos), 6) AS grade FROM hh a JOIN hh b ON b.chain = a.chain AND b.n = a.n + 1"),
    "section_twins": (section_twins, None),
    "track_edges": (track_edges, "WITH RECURSIVE " + FIX_SQL + """, p AS (SELECT ride_id, seq, -(ride_id * 100000 + seq) - 1 AS id, seq * 10::DOUBLE AS x, (seq * seq % 23 + ride_id % 7 * 50)::DOUBLE AS y, max(seq) OVER (PARTITION BY ride_id) AS last FROM fix),
g AS (SELECT ride_id, seq, id, x, y, x AS kx, y AS ky, true AS keep, last FROM p WHERE seq = 0 UNION ALL SELECT ride_id, seq, id, x, y, CASE WHEN far THEN x ELSE kx END, CASE WHEN far THEN y ELSE ky END, far OR seq = last, last FROM (SELECT p.*, g.kx, g.ky, sqrt(pow(p.x - g.kx, 2) + pow(p.y - g.ky, 2)) >= 20 AS far FROM g JOIN p ON p.ride_id = g.ride_id AND p.seq = g.seq + 1)),
k AS (SELECT *, lead(id) OVER w AS b, lead(x) OVER w AS bx, lead(y) OVER w AS yy FROM g WHERE keep AND last > 0 WINDOW w AS (PARTITION BY ride_id ORDER BY seq)),
r AS (SELECT s, ax, ay, ax + 30 - s % 7 * 10 AS bx, ay + 25.5 AS yy FROM (SELECT c_custkey AS s, c_custkey % 97 * 11.25::DOUBLE AS ax, c_custkey % 41 * 9.5::DOUBLE AS ay FROM customer)),
j AS (SELECT k.id, k.x, k.y, r.*, ((k.x - ax) * (r.bx - ax) + (k.y - ay) * (r.yy - ay)) / (pow(r.bx - ax, 2) + pow(r.yy - ay, 2)) AS t FROM k JOIN r ON k.x BETWEEN least(ax, r.bx) - 15 AND greatest(ax, r.bx) + 15 AND k.y BETWEEN ay - 15 AND r.yy + 15),
n AS (SELECT *, sqrt(pow(x - ax - greatest(0, least(1, t)) * (bx - ax), 2) + pow(y - ay - greatest(0, least(1, t)) * (yy - ay), 2)) AS d FROM j),
l AS (SELECT * FROM n WHERE d <= 15 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(d, 6), s) = 1),
e AS (SELECT id AS a, b, sqrt(pow(bx - x, 2) + pow(yy - y, 2)) AS meters, 'track' AS kind FROM k WHERE b IS NOT NULL UNION ALL SELECT id, CASE WHEN t < 0.5 THEN s ELSE s + 1 END, CASE WHEN t < 0.5 THEN sqrt(pow(x - ax, 2) + pow(y - ay, 2)) ELSE sqrt(pow(x - bx, 2) + pow(y - yy, 2)) END, 'link' FROM l) SELECT a, b, round(meters, 4) AS meters, round(2 * meters, 4) AS cost, kind FROM e"""),
    "graph_build": (graph_build, "WITH o AS (SELECT o_orderkey AS i, o_custkey AS way, (o_orderkey * 7919) % 41 * 2 AS x, (o_orderkey * 104729) % 43 * 2 AS y FROM orders), n AS (SELECT *, min(i) OVER (PARTITION BY x, y) AS a FROM o), l AS (SELECT *, lead(a) OVER w AS b, lead(x) OVER w AS bx, lead(y) OVER w AS yy FROM n WINDOW w AS (PARTITION BY way ORDER BY i)), m AS (SELECT *, sqrt(pow(bx - x, 2) + pow(yy - y, 2)) * 2.5::DOUBLE AS meters FROM l WHERE b <> a) SELECT way, i, a, b, round(meters, 4) AS meters, round(meters * (1 + way % 3), 4) AS forward, round(meters * (1 + way % 5), 4) AS backward, (way % 4)::INT AS rank FROM m WHERE way IN (SELECT c_custkey FROM customer)"),
}
