"""Turn-by-turn steps of routes: junctions that a route passes, close ones as one turn, headings on both sides, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .routes import junction_near, street_names

# fixed values: metres and degrees
WINDOW_M, CLUSTER_M, LOOK_M, START_M = 15.0, 20.0, 20.0, 5.0
STRAIGHT, SLIGHT, SHARP, U_TURN, SAME_ROAD = 30, 60, 135, 165, 60


def heading(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees from north, clockwise; y grows to the south."""
    return F.degrees(F.atan2(bx - ax, ay - by))


def signed(degrees: Column) -> Column:
    """An angle brought above -180 and up to 180."""
    d = F.pmod(degrees, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def measured(points: DataFrame) -> DataFrame:
    """Points (route, i, x, y) with `along`, the metres up to each. Those without a place or number are none."""
    w = Window.partitionBy("route").orderBy("i")
    p = points.dropna(subset=["route", "i", "x", "y"]).select("route", "i", "x", "y")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return p.withColumn("_step", step).withColumn("along", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def points_at(line: DataFrame, asked: DataFrame) -> DataFrame:
    """Where on its route each asked distance (route, key, at) lies: (route, key, x, y), between the last vertex before it
    and the first at or after it, or the nearer end. One sorted pass over vertices and distances together, no join."""
    v = line.select("route", F.col("along").alias("at"), "i", F.struct("along", "x", "y").alias("p"), F.lit(None).cast("string").alias("key"))
    q = asked.select("route", "at", F.lit(-1).cast("bigint").alias("i"), F.lit(None).cast(v.schema["p"].dataType).alias("p"), "key")
    w = Window.partitionBy("route").orderBy("at", F.col("p").isNotNull(), "i")  # a distance comes before a vertex just there
    both = v.withColumn("i", F.col("i").cast("bigint")).unionByName(q)
    both = both.withColumns({"a": F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "b": F.first("p", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    t = F.coalesce(F.try_divide(F.col("at") - F.col("a.along"), F.col("b.along") - F.col("a.along")), F.lit(0.0))
    mid = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t)
    return both.where("p IS NULL").select("route", "key", mid("x").alias("x"), mid("y").alias("y"))


def turn_steps(points: DataFrame, nodes: DataFrame, edges: DataFrame, ways: DataFrame, reach: float) -> DataFrame:
    """(route, i, along, turn, angle, name, kind, stay) of routes (route, i, x, y) in metres, y to the south.

    A turn is at a junction: a node (node, x, y) with three neighbours or more by edges (a, b), within `reach` of a point
    inside the route; of points in a row at one junction the nearest counts, and junctions less than 20 metres after the
    one before are one turn. Its angle is that from the heading over the 15 metres before the first to that over the 15
    after the last. Under 30 degrees is no turn. Names are those of ways (ax, ay, bx, by, name, kind) 20 metres before
    and after; under 60 degrees on a road that keeps its name is none either. Turns within 5 metres of the start go. A
    route's last step is the arrival.
    """
    line = measured(points)
    last = line.groupBy("route").agg(F.max("i").alias("last"), F.max("along").alias("total"))
    inner = line.join(last, "route").withColumn("first", F.min("i").over(Window.partitionBy("route"))).where("i > first AND i < last")
    met = junction_near(inner.select(F.struct("route", "i").alias("id"), "x", "y"), nodes, edges, reach).select("id.*", "node", "distance")
    w = Window.partitionBy("route").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("row", F.sum(F.coalesce((F.col("node") != F.lag("node").over(w)).cast("int"), F.lit(0))).over(upto))
    one = met.groupBy("route", "row").agg(F.min_by("i", F.struct("distance", "i")).alias("i")).join(line.select("route", "i", "x", "y", "along"), ["route", "i"])
    one = one.withColumn("cluster", F.sum((F.coalesce(F.col("along") - F.lag("along").over(w), F.lit(0.0)) >= CLUSTER_M).cast("int")).over(upto))
    end = lambda how, c: how(c, "i").alias
    c = one.groupBy("route", "cluster").agg(F.min("i").alias("i"), *[end(F.min_by, x)(f"a_{x}") for x in ("x", "y", "along")], *[end(F.max_by, x)(f"b_{x}") for x in ("x", "y", "along")]).where(F.col("a_along") >= START_M)
    key = lambda what: F.concat_ws(":", F.lit(what), "cluster")
    spots = {"in": F.col("a_along") - WINDOW_M, "out": F.col("b_along") + WINDOW_M, "from": F.col("a_along") - LOOK_M, "onto": F.col("b_along") + LOOK_M}
    asked = c.select("route", "cluster", F.explode(F.array(*[F.struct(key(k).alias("key"), at.alias("at")) for k, at in spots.items()])).alias("q")).select("route", "q.*")
    found = points_at(line, asked).select("route", F.split("key", ":")[0].alias("what"), F.split("key", ":")[1].cast("bigint").alias("cluster"), F.struct("x", "y").alias("p"))
    placed = found.groupBy("route", "cluster").agg(*[F.first(F.when(F.col("what") == k, F.col("p")), ignorenulls=True).alias(f"p_{k}") for k in spots])
    c = c.join(placed, ["route", "cluster"])
    c = c.withColumns({"h_in": heading(F.col("p_in.x"), F.col("p_in.y"), F.col("a_x"), F.col("a_y")), "h_out": heading(F.col("b_x"), F.col("b_y"), F.col("p_out.x"), F.col("p_out.y"))})
    c = c.withColumn("angle", signed(F.col("h_out") - F.col("h_in"))).where(F.abs("angle") >= STRAIGHT)
    ask = c.select("route", "cluster", F.explode(F.array(F.struct(F.lit("from").alias("what"), F.col("p_from").alias("p"), F.col("h_in").alias("h")), F.struct(F.lit("onto").alias("what"), F.col("p_onto").alias("p"), F.col("h_out").alias("h")))).alias("q"))
    names = street_names(ask.select(F.struct("route", "cluster", "q.what").alias("id"), F.col("q.p.x").alias("x"), F.col("q.p.y").alias("y"), F.col("q.h").alias("heading")), ways, looks=()).select("id.*", "name", "kind")
    of = lambda what, *cols: names.where(F.col("what") == what).select("route", "cluster", *cols)
    c = c.join(of("onto", "name", "kind"), ["route", "cluster"], "left").join(of("from", F.col("name").alias("was")), ["route", "cluster"], "left")
    size = F.abs("angle")
    c = c.withColumn("stay", F.coalesce(F.col("was") == F.col("name"), F.lit(False))).where(~F.col("stay") | (size >= SAME_ROAD))
    side = F.when(F.col("angle") > 0, "right").otherwise("left")
    turn = F.when(size >= U_TURN, "uturn").when(size >= SHARP, F.concat(F.lit("sharp-"), side)).when(size >= SLIGHT, side).otherwise(F.concat(F.lit("slight-"), side))
    steps = c.select("route", "i", F.col("a_along").alias("along"), turn.alias("turn"), "angle", "name", "kind", "stay")
    none = lambda kind: F.lit(None).cast(kind)
    arrive = last.select("route", F.col("last").alias("i"), F.col("total").alias("along"), F.lit("arrive").alias("turn"), none("double").alias("angle"), none("string").alias("name"), none("string").alias("kind"), F.lit(False).alias("stay"))
    return steps.unionByName(arrive)


#: fixed values: turns in words
WORDS = {"left": "Turn left", "right": "Turn right", "slight-left": "Bear left", "slight-right": "Bear right", "sharp-left": "Sharp left", "sharp-right": "Sharp right", "uturn": "Make a U-turn"}


def instruction(turn: Column, name: Column, kind: Column, stay: Column) -> Column:
    """A turn in words, with the way that it is onto where that is known; null for the arrival."""
    said = F.coalesce(*[F.when(turn == k, v) for k, v in WORDS.items()])
    way = F.coalesce(name, F.concat(F.lit("the "), kind))
    return F.when(way.isNull(), said).otherwise(F.concat(said, F.when(stay, " to stay on ").otherwise(" onto "), way))
