"""Edits of routes, with their DuckDB SQL: the log applied to lists, edit by edit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import edits as E
from ..sources.lenses import _hash32, read

OPS = ["append", "append", "append", "move", "insert", "remove", "append", "add_place", "add_place", "move_place", "mark_place", "remove_place"]


def route_edits(spark, d):
    """Customers as routes: their first four orders are the stored waypoints, the others edits."""
    h = _hash32(F.col("o_orderkey"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("n"), h.alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("route_id").orderBy("n")))
    o = o.withColumns({"lat": F.lit(47.0) + F.col("h") % 1000 / 10000, "lng": F.lit(8.0) + F.expr("h div 1000") % 1000 / 10000})
    op = F.element_at(F.array(*map(F.lit, OPS)), (F.expr("h div 7") % len(OPS) + 1).cast("int"))
    s = o.where("k <= 4").select("route_id", F.col("k").alias("i"), "lat", "lng")
    e = o.where("k > 4").select("route_id", "n", op.alias("op"), (F.expr("h div 91") % 5).alias("at"), "lat", "lng", F.when(F.col("h") % 3 == 0, "tent").alias("icon"), F.concat(F.lit("Place "), F.col("n")).alias("title"))
    return E.edited(s, e).select("route_id", "kind", "i", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "icon", "title", "leg", "anew")


EDITS_SQL = f"""WITH RECURSIVE o AS (SELECT o_custkey AS route_id, o_orderkey AS n, ('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT AS h, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
p AS (SELECT *, {{'lat': 47::DOUBLE + h % 1000 / 10000, 'lng': 8::DOUBLE + (h // 1000) % 1000 / 10000}} AS spot, ({OPS!r})[((h // 7) % {len(OPS)} + 1)::INT] AS op, ((h // 91) % 5)::INT AS pos, CASE WHEN h % 3 = 0 THEN 'tent' END AS icon, 'Place ' || n AS title FROM o),
s AS (SELECT route_id, list(spot ORDER BY k) AS w, count(*) AS c FROM p WHERE k <= 4 GROUP BY route_id),
g AS (SELECT route_id, 4 AS k, w, CASE WHEN c > 1 THEN list_transform(range(0, c - 1), lambda x: x::BIGINT) ELSE []::BIGINT[] END AS l, []::STRUCT(lat DOUBLE, lng DOUBLE, icon VARCHAR, title VARCHAR)[] AS q FROM s
  UNION ALL SELECT g.route_id, p.k::INT,
    CASE WHEN op = 'append' THEN list_append(w, spot) WHEN op = 'move' AND pos < len(w) THEN w[:pos] || [spot] || w[pos + 2:] WHEN op = 'insert' AND pos < len(l) THEN w[:pos + 1] || [spot] || w[pos + 2:] WHEN op = 'remove' AND pos < len(w) THEN w[:pos] || w[pos + 2:] ELSE w END,
    CASE WHEN op = 'append' AND len(w) > 0 THEN list_append(l, NULL) WHEN op = 'move' AND pos < len(w) THEN CASE WHEN pos > 0 THEN l[:pos - 1] || [NULL]::BIGINT[] ELSE []::BIGINT[] END || CASE WHEN pos < len(l) THEN [NULL]::BIGINT[] || l[pos + 2:] ELSE []::BIGINT[] END
      WHEN op = 'insert' AND pos < len(l) THEN l[:pos] || [NULL, NULL]::BIGINT[] || l[pos + 2:] WHEN op = 'remove' AND pos < len(w) THEN CASE WHEN pos = 0 THEN l[2:] WHEN pos = len(w) - 1 THEN l[:len(l) - 1] ELSE l[:pos - 1] || [NULL]::BIGINT[] || l[pos + 2:] END ELSE l END,
    CASE WHEN op = 'add_place' AND len(q) < 50 THEN list_append(q, {{'lat': spot.lat, 'lng': spot.lng, 'icon': NULL, 'title': ''}}) WHEN op = 'move_place' AND pos < len(q) THEN q[:pos] || [{{'lat': spot.lat, 'lng': spot.lng, 'icon': q[pos + 1].icon, 'title': q[pos + 1].title}}] || q[pos + 2:]
      WHEN op = 'mark_place' AND pos < len(q) THEN q[:pos] || [{{'lat': q[pos + 1].lat, 'lng': q[pos + 1].lng, 'icon': p.icon, 'title': p.title}}] || q[pos + 2:] WHEN op = 'remove_place' AND pos < len(q) THEN q[:pos] || q[pos + 2:] ELSE q END
  FROM g JOIN p ON p.route_id = g.route_id AND p.k = g.k + 1),
z AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY k DESC) = 1),
ws AS (SELECT route_id, l, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM z), qs AS (SELECT route_id, unnest(range(0, len(q))) AS i, unnest(q) AS x FROM z)
SELECT route_id, 'waypoint' AS kind, i, round(x.lat, 6) AS lat, round(x.lng, 6) AS lng, NULL AS icon, NULL AS title, l[i + 1] AS leg, i < len(l) AND l[i + 1] IS NULL AS anew FROM ws
UNION ALL SELECT route_id, 'place', i, round(x.lat, 6), round(x.lng, 6), x.icon, x.title, NULL, false FROM qs
"""

QUERIES = {"route_edits": (route_edits, EDITS_SQL)}
