"""Sections, junctions, street names, slopes and rows of planned routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import angle_between, dbl
from .graph import written


def cells_around(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Every row in its own cell (cx, cy) and the eight around it."""
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    df = df.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    return df.withColumns({"cx": F.floor(x / size) + F.col("_dx"), "cy": F.floor(y / size) + F.col("_dy")}).drop("_dx", "_dy")


def in_cell(df: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(x / size), "cy": F.floor(y / size)})


def slopes_ahead(samples: DataFrame, spacing: float = 20.0, climbs_only: bool = False, show: float = 0.02, moderate: float = 0.05, within: float = 400.0, least: float = 80.0) -> DataFrame:
    """The first climb or descent worth showing of every profile (ride_id, k, altitude), samples `spacing` apart.

    Pieces are two samples long. A slope starts on a piece of `moderate` or more and goes on while pieces keep its
    sign by `show` or more; it counts if it is `least` metres long, means `moderate`, and starts `within` metres.
    Such a slope is the end of a stretch of pieces of one sign, from the stretch's first moderate piece on, so no
    scan is needed: stretches are islands. Profiles without a slope give no row, nor do single samples.
    """
    w = Window.partitionBy("ride_id").orderBy("k")
    s = samples.withColumns({"i": F.row_number().over(w) - 1, "one": F.lead("altitude", 1).over(w), "two": F.lead("altitude", 2).over(w)}).where("i % 2 = 0 AND one IS NOT NULL")
    run = F.when(F.col("two").isNotNull(), 2 * spacing).otherwise(spacing)
    p = s.select("ride_id", "k", (F.col("i") * spacing).alias("start"), run.alias("run"), ((F.coalesce("two", "one") - F.col("altitude")) / run).alias("grade"))
    sign = F.when(F.abs("grade") >= show, F.signum("grade")).otherwise(0.0)
    p = p.withColumn("sign", sign).withColumn("stretch", F.sum(F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begins = F.col("grade") >= moderate if climbs_only else F.abs("grade") >= moderate
    own = Window.partitionBy("ride_id", "stretch")
    p = p.where("sign <> 0").withColumn("first", F.min(F.when(begins, F.col("start"))).over(own)).where("start >= first")
    g = p.groupBy("ride_id", "stretch").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("run")).alias("stop"), (F.sum(F.col("grade") * F.col("run")) / F.sum("run")).alias("grade"))
    g = g.where((F.col("start") <= within) & (F.col("stop") - F.col("start") >= least) & (F.abs("grade") >= moderate))
    return g.groupBy("ride_id").agg(F.min_by(F.struct("start", "stop", "grade"), "start").alias("s")).select("ride_id", "s.*")


def junction_near(points: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """For points (id, x, y) the nearest node (node, x, y) with at least `least` distinct neighbours within `radius`;
    ties go to the lower node. Points with none give no row."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.countDistinct("b").alias("degree")).where(F.col("degree") >= least)
    n = cells_around(nodes.join(degree, "node"), F.col("x"), F.col("y"), radius).withColumnsRenamed({"x": "nx", "y": "ny"})
    # exploded rows look small to the planner, which would gather them in the driver to broadcast them
    met = in_cell(points, F.col("x"), F.col("y"), radius).hint("merge").join(n, ["cx", "cy"])
    met = met.withColumn("distance", F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).where(F.col("distance") <= radius)
    return met.groupBy("id").agg(F.min(F.struct("distance", "node", "degree")).alias("m")).select("id", "m.node", "m.degree", "m.distance")


def street_names(points: DataFrame, ways: DataFrame, reach: float = 12.0, turned: float = 35.0, cell: float = 64.0, looks: tuple[int, ...] = (16, 4)) -> DataFrame:
    """For points (id, x, y, heading) the name of the nearest named way and the kind of the nearest unnamed one, of the
    segments (ax, ay, bx, by, name, kind) within `reach` whose axis is within `turned` degrees of the heading.

    Looks a sixteenth and a quarter of the reach around first, in smaller cells: a point that finds both there has the
    nearest, and only the others look on, so crowded cells are not met whole. `looks` may be empty where ways lie far apart.
    """
    if not looks:
        return _named_within(points, ways, reach, turned, cell).select("id", "name", "kind")
    ways, left, parts = written(ways), written(points), []
    for part in looks:
        near = reach / part
        parts.append(written(_named_within(left, ways, near, turned, max(8.0, cell / part)).where((F.col("_name") <= near - 1e-5) & (F.col("_kind") <= near - 1e-5))))
        left = written(left.join(parts[-1].select(F.col("id").alias("_found")), F.col("id").eqNullSafe(F.col("_found")), "left_anti"))
    out = _named_within(left, ways, reach, turned, cell)
    for found in parts:
        out = out.unionByName(found)
    return out.select("id", "name", "kind")


def _named_within(points: DataFrame, ways: DataFrame, reach: float, turned: float, cell: float) -> DataFrame:
    """As `street_names`, with the distances `_name` and `_kind`. A segment is put in every cell that it comes within the reach
    of, one column of cells after another, so a point asks its own cell alone."""
    r = reach * 1.001
    span = lambda lo, hi: F.sequence(F.floor((lo - r) / cell), F.floor((hi + r) / cell))
    w = ways.where("ax <> bx OR ay <> by").withColumn("cx", F.explode(span(F.least("ax", "bx"), F.greatest("ax", "bx"))))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = lambda x: F.greatest(dbl(0), F.least(dbl(1), F.try_divide(x - F.col("ax"), dx)))
    y0, y1 = (F.when(dx == 0, F.col(e)).otherwise(F.col("ay") + share(x) * dy) for e, x in (("ay", F.col("cx") * cell - r), ("by", (F.col("cx") + 1) * cell + r)))
    w = w.withColumn("cy", F.explode(span(F.least(y0, y1), F.greatest(y0, y1))))
    met = in_cell(points, F.col("x"), F.col("y"), cell).join(w, ["cx", "cy"])
    close = lambda c: (F.col(c) >= F.least(f"a{c}", f"b{c}") - r) & (F.col(c) <= F.greatest(f"a{c}", f"b{c}") + r)
    met = met.where(close("x") & close("y"))
    u = F.greatest(dbl(0), F.least(dbl(1), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    met = met.withColumn("distance", F.hypot(F.col("x") - F.col("ax") - u * dx, F.col("y") - F.col("ay") - u * dy))
    off = angle_between(F.degrees(F.atan2(dx, -dy)), F.col("heading"))
    met = met.where((F.col("distance") < reach) & (F.least(off, 180 - off) <= turned))
    nearest = lambda what, on: F.min(F.when(on, F.struct("distance", F.col(what).alias("v")))).getField("v").alias(what)
    named, kind = F.col("name").isNotNull(), F.col("name").isNull() & F.col("kind").isNotNull()
    far = lambda on: F.min(F.when(on, F.col("distance")))
    return met.groupBy("id").agg(nearest("name", named), nearest("kind", kind), far(named).alias("_name"), far(kind).alias("_kind"))


def same_section(found: DataFrame, stored: DataFrame, middle: float = 10.0, share: float = 0.3, ratio: float = 1.4, turned: float = 45.0) -> DataFrame:
    """For found road sections (id, activity, x, y, bearing, meters; x and y of the middle, in metres) the stored one
    (record, the same columns, both_ways) that is the same stretch: alike in length, ridden the same way or, where it
    serves both, the other way, its middle within `middle` metres and a share of the length; the nearest, then the
    lowest record. Sections with none give no row."""
    s, left, parts = written(stored.withColumnsRenamed({"x": "sx", "y": "sy", "bearing": "sb", "meters": "sm"})), written(found), []
    for part in (16, 4):  # what is found near is the nearest; only sections that find nothing look on
        parts.append(written(_same_within(left, s, middle / part, share, ratio, turned)))
        left = written(left.join(parts[-1].select(F.col("id").alias("_found")), F.col("id").eqNullSafe(F.col("_found")), "left_anti"))
    return parts[0].unionByName(parts[1]).unionByName(_same_within(left, s, middle, share, ratio, turned))


def _same_within(found: DataFrame, s: DataFrame, middle: float, share: float, ratio: float, turned: float) -> DataFrame:
    side = middle * 1.001
    met = cells_around(found, F.col("x"), F.col("y"), side).hint("merge").join(in_cell(s, F.col("sx"), F.col("sy"), side), ["cx", "cy", "activity"])
    off = angle_between(F.col("sb"), F.col("bearing"))
    met = met.withColumn("distance", F.hypot(F.col("sx") - F.col("x"), F.col("sy") - F.col("y")))
    alike = (F.col("sm") <= F.col("meters") * ratio) & (F.col("sm") * ratio >= F.col("meters"))
    ok = alike & ((off <= turned) | (F.col("both_ways") & (off >= 180 - turned))) & (F.col("distance") <= F.least(dbl(middle), F.col("meters") * share))
    return met.where(ok).groupBy("id").agg(F.min(F.struct("distance", "record")).alias("m")).select("id", "m.record", "m.distance")


#: fixed values: road classes that are no roads to ride
NO_ROADS = ("rail", "transit", "ferry", "aerialway", "pier")


def roads_in_view(lines: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Lines (line_id, class, brunnel, coords: array of (lng, lat)) with a vertex in view, without bridges, tunnels and
    what is no road; lines that share both ends to five decimals are one, the lowest line_id's."""
    inside = F.exists("coords", lambda c: c.lng.between(west, east) & c.lat.between(south, north))
    skip = F.coalesce(F.col("class").isin(*NO_ROADS), F.lit(False)) | F.coalesce(F.col("brunnel").isin("bridge", "tunnel"), F.lit(False))
    ends = [F.round(F.element_at("coords", i).getField(f), 5).alias(f"{f}{j}") for i, j in ((1, 0), (-1, 1)) for f in ("lng", "lat")]
    kept = lines.where(~skip & (F.size("coords") >= 2) & inside).select("*", *ends)
    return kept.groupBy("lng0", "lat0", "lng1", "lat1").agg(F.min("line_id").alias("line_id")).select("line_id")


def compass_headings(events: DataFrame) -> DataFrame:
    """North-referenced headings of orientation events (compass, alpha, absolute): the compass, else the reversed
    alpha where it is absolute; relative ones go."""
    finite = F.col("compass").isNotNull() & ~F.isnan("compass") & (F.abs("compass") < float("inf"))
    heading = F.when(finite, F.pmod(F.col("compass"), dbl(360))).when(F.coalesce("absolute", F.lit(False)) & F.col("alpha").isNotNull(), F.pmod(dbl(360) - F.col("alpha"), dbl(360)))
    return events.withColumn("heading", heading).where("heading IS NOT NULL")


def route_flags(routes: DataFrame) -> DataFrame:
    """Rows of routes (waypoints, legs, coords, places, destination, source) with `valid`, `can_follow` and `is_empty`."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    has = lambda c: F.col(c).isNotNull()
    return routes.withColumns({
        "valid": has("waypoints") & has("legs") & has("coords"),
        "can_follow": F.coalesce("destination", F.lit(False)) | (~F.col("source").eqNullSafe("gpx") & (F.greatest(n("waypoints"), F.lit(0)) >= 2)),
        "is_empty": (F.greatest(n("waypoints"), F.lit(0)) == 0) & (F.greatest(n("legs"), F.lit(0)) == 0) & (F.greatest(n("places"), F.lit(0)) == 0),
    })


def restored(checkpoints: DataFrame, now_ms: Column) -> DataFrame:
    """Live rows of checkpoints: defaults for what is missing, paused now, with a pause from where the ride stood still
    (the open pause, else the last fix) to now."""
    stood = F.coalesce("pause_started_ms", "last_fix_ms")
    own = F.coalesce("pauses", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    gap = F.struct(stood.cast("long").alias("start"), now_ms.cast("long").alias("stop"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return checkpoints.select(
        "ride_id", F.coalesce(F.nullif("activity", F.lit("")), F.lit("bike")).alias("activity"), F.when(F.col("route_mode") == "points", "points").otherwise("asis").alias("route_mode"),
        zero("next_waypoint"), zero("total_distance"), zero("moving_time_ms"),
        F.when(stood.isNotNull() & (now_ms > stood), F.array_append(own, gap)).otherwise(own).alias("pauses"), F.lit(None).cast("long").alias("pause_started_ms"), now_ms.cast("long").alias("resumed_ms"),
    )


def with_pinned(kept: DataFrame, fixes: DataFrame, pauses: DataFrame) -> DataFrame:
    """Kept fixes (ride_id, seq) and the ones on either side of a pause, each once, for rides that have a pause."""
    w = Window.partitionBy("ride_id").orderBy("seq")
    s = fixes.select("ride_id", "seq", "t_ms", F.lead("t_ms").over(w).alias("next_t"), F.lead("seq").over(w).alias("next_seq")).where("next_t IS NOT NULL")
    met = s.join(pauses, "ride_id").where("start < next_t AND coalesce(stop, next_t) > t_ms AND coalesce(stop, next_t) > start")
    pinned = met.select("ride_id", F.explode(F.array("seq", "next_seq")).alias("seq"))
    return kept.select("ride_id", "seq").unionByName(pinned).distinct()


def box_exit(x: Column, y: Column, dx: Column, dy: Column, w: float, h: float) -> Column:
    """How far along (dx, dy) a ray from inside a box of w by h leaves it; infinite for no direction."""
    far = dbl(float("inf"))
    along = lambda p, d, size: F.when(d > 0, (dbl(size) - p) / d).when(d < 0, -p / d).otherwise(far)
    return F.least(along(x, dx, w), along(y, dy, h))
