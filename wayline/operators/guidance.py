"""What a rider is told, and the rows of planned routes: steps, banners, hills, legs, saves and imports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import angle_between, bearing, haversine
from .folds import in_order

#: fixed values: when a rider is told to turn around, and how far a hill may move and still be the same
AWAY_DEGREES, AWAY_SPEED, AWAY_METERS, SAME_HILL_METERS = 120.0, 1.5, 25.0, 40.0


def guidance_kind(home_asked: Column, home_ready: Column, home_allowed: Column, plan_ready: Column, plan_finished: Column, plan_wanted: Column) -> Column:
    """Directions home where they were asked for and are there, else the plan while it lasts and is wanted; else null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    home = yes(home_asked) & yes(home_ready) & yes(home_allowed)
    return F.when(home, "home").when(yes(plan_ready) & ~yes(plan_finished) & yes(plan_wanted), "route")


def banners(riders: DataFrame, steps: DataFrame) -> DataFrame:
    """What is shown to riders (id, lat, lng, speed, heading, along, off_route, target_meters, target_lat, target_lng)
    of the steps (id, i, along, turn, lat, lng) before them.

    The next step is the first in the order of i that lies more than a metre ahead; after it comes one more unless it
    is the arrival. `progress` is the share ridden of the way from the step before. Off the route there is no step. A
    rider who goes fast enough, more than 120 degrees off the way to the next step (or to the target) and not too
    close to it, is told to turn around.
    """
    met = steps.join(riders.select("id", F.col("along").alias("_at")), "id")
    first = F.min(F.when(F.col("along") > F.col("_at") + 1, F.col("i"))).over(Window.partitionBy("id"))
    s = F.struct("along", "turn", "lat", "lng")
    pick = lambda k: F.max(F.when(F.col("i") == F.col("_first") + k, s))
    g = met.withColumn("_first", first).groupBy("id").agg(pick(-1).alias("before"), pick(0).alias("next"), pick(1).alias("after"))
    r = riders.join(g, "id", "left")
    off, away_lat, away_lng = F.coalesce("off_route", F.lit(False)), F.coalesce("next.lat", "target_lat"), F.coalesce("next.lng", "target_lng")
    begun = F.coalesce("before.along", F.lit(0.0))
    toward = F.when(haversine(F.col("lat"), F.col("lng"), away_lat, away_lng) >= AWAY_METERS, bearing(F.col("lat"), F.col("lng"), away_lat, away_lng))
    away = F.coalesce((F.col("speed") >= AWAY_SPEED) & (angle_between(toward, F.col("heading")) > AWAY_DEGREES), F.lit(False))
    there = F.col("next").isNotNull()
    share = (F.col("along") - begun) / F.greatest(F.lit(1.0), F.col("next.along") - begun)
    return r.select(
        "id", F.when(off, "reroute").when(away, "uturn").when(there, F.col("next.turn")).otherwise("straight").alias("icon"), (~off & away).alias("turn_around"),
        F.when(~off, F.col("next.turn")).alias("turn"), F.when(~off & (F.col("next.turn") != "arrive"), F.col("after.turn")).alias("after_turn"),
        F.when(there, F.col("next.along") - F.col("along")).otherwise(F.col("target_meters")).alias("distance"),
        F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(0.0).alias("progress"),
    )


def steps_to_stop(routes: DataFrame, live: DataFrame, planned: DataFrame) -> DataFrame:
    """Steps (id, along, turn) to the next stop of routes (id, next_point, stop_point, live_total, from_m, to_m).

    Where the next point is the stop, the live steps. Else the live ones without their arrival, then the planned line's
    from five metres before the next point (from_m) to a metre before the stop (to_m), counted on from the end of the
    live route, then arriving at the stop. A route whose plan is not worked out (no planned steps) gets the live ones.
    """
    r = routes.withColumn("shift", F.col("live_total") - F.col("from_m"))
    direct = F.col("next_point").eqNullSafe(F.col("stop_point"))
    own = live.join(r.select("id", direct.alias("direct")), "id").where(F.col("direct") | (F.col("turn") != "arrive")).select("id", "along", "turn")
    via = r.where(~direct)
    later = planned.join(via, "id").where("turn <> 'arrive' AND along >= from_m - 5 AND along < to_m - 1").select("id", (F.col("along") + F.col("shift")).alias("along"), "turn")
    end = via.join(planned.select("id").distinct(), "id", "left_semi").select("id", (F.col("to_m") + F.col("shift")).alias("along"), F.lit("arrive").alias("turn"))
    return own.unionByName(later).unionByName(end)


def same_hills(climbs: DataFrame) -> DataFrame:
    """Climbs (ride_id, seq, along, start, stop) as reported again and again: (ride_id, seq, hill, start, stop).

    A report that overlaps the current hill within 40 m is that hill, whose end it moves; another one begins the next
    hill only once the rider is past the current hill's end, and is passed over before. Reports without a start or
    stop are none and say what the current hill is (null before the first). A task holds one hill.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hill, start, stop = None, None, None, None
        for b in batches:
            out = []
            for ride, along, a, z in zip(*[b.column(c).to_pylist() for c in ("ride_id", "along", "start", "stop")]):
                if ride != own:
                    own, hill, start, stop = ride, None, None, None
                if a is not None and z is not None:
                    if hill is not None and a <= stop + SAME_HILL_METERS and z >= start - SAME_HILL_METERS:
                        stop = z
                    elif hill is None or (along is not None and along > stop):
                        hill, start, stop = (0 if hill is None else hill + 1), a, z
                out.append((hill, start, stop))
            cols = list(zip(*out)) or [(), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("ride_id"), b.column("seq"), *arrays], names=["ride_id", "seq", "hill", "start", "stop"])

    c = climbs.select("ride_id", "seq", F.col("along").cast("double"), F.col("start").cast("double"), F.col("stop").cast("double"))
    return in_order(c, "ride_id", "seq").mapInArrow(run, "ride_id long, seq long, hill long, start double, stop double")


def assembled(legs: DataFrame) -> DataFrame:
    """Routes of legs (route_id, i, coords, meters, pending): the joined line (each leg after the first without its
    first point), its length, the key of its height profile, and whether a profile can be measured (two points or
    more and no leg pending). A route's legs are few; they make one row."""
    leg = F.struct("i", "coords", "meters", F.coalesce("pending", F.lit(False)).alias("pending"))
    r = legs.groupBy("route_id").agg(F.sort_array(F.collect_list(leg)).alias("legs"))
    joined = F.flatten(F.transform("legs", lambda g, k: F.when(k == 0, g.coords).otherwise(F.slice(g.coords, 2, F.greatest(F.lit(0), F.size(g.coords) - 1)))))
    r = r.select("route_id", joined.alias("coords"), F.aggregate("legs", F.lit(0.0), lambda s, g: s + F.coalesce(g.meters, F.lit(0.0))).alias("meters"), F.exists("legs", lambda g: g.pending).alias("waiting"))
    key = F.concat_ws(":", F.size("coords"), F.floor(F.col("meters") + 0.5))
    return r.select("route_id", "coords", "meters", key.alias("profile_key"), ((F.size("coords") >= 2) & ~F.col("waiting")).alias("measurable"))


def saved(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored routes (id, name, updated, n_points, meters) after edits (the same and preview, deleted): the last save
    of each id by `updated`, without ids whose delete came. Previews are not saved, nor are empty routes that have no
    row yet; a missing name becomes a plain one."""
    cols = ["id", "name", "updated", "n_points", "meters"]
    gone = edits.where("deleted").select("id").distinct()
    real = edits.where("NOT coalesce(preview, false) AND NOT coalesce(deleted, false)").select(*cols)
    new = real.where("coalesce(n_points, 0) > 0").unionByName(real.where("coalesce(n_points, 0) = 0").join(stored.select("id"), "id", "left_semi").select(*cols))
    new = new.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Untitled route")))
    both = stored.select(*cols, F.lit(0).alias("_new")).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy("id").agg(F.max_by(F.struct("name", "updated", "n_points", "meters"), F.struct("updated", "_new", "name", "n_points", "meters")).alias("r"))
    return last.join(gone, "id", "left_anti").select("id", "r.*")


def imported(files: DataFrame, as_drawn: Column, thinned: Column) -> DataFrame:
    """Route files (id, track, points) as routes: as drawn, the track (else the points) is the one leg and there are
    no waypoints; else the points, or where there are none the thinned track, are waypoints to be routed in pairs."""
    drawn = F.coalesce(as_drawn, F.lit(True))
    line, points = F.coalesce("track", "points"), F.coalesce("points", thinned)
    none = F.slice(line, 1, 0)
    return files.select(
        "id", F.when(drawn, "gpx").otherwise("planned").alias("source"), F.when(drawn, none).otherwise(points).alias("waypoints"),
        F.when(drawn, F.array(line)).otherwise(F.transform(F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)), lambda p, k: F.array(F.get(points, k), p))).alias("legs"),
    )


def finalised(live: DataFrame, now_ms: Column) -> DataFrame:
    """Saved rows of live rides (ride_id, activity, total_distance, moving_time_ms, pauses, pause_started_ms, n_points,
    route_id, ..) that end at now_ms: an open pause is closed, the mean speed follows from the totals, the activity has
    its default. Rides of fewer than two fixes are not saved. Null totals are 0."""
    open_pause = F.col("pause_started_ms").isNotNull() & (F.col("pause_started_ms") < now_ms)
    own = F.coalesce("pauses", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    end = F.struct(F.col("pause_started_ms").cast("long").alias("start"), now_ms.cast("long").alias("stop"))
    meters, ms = F.coalesce("total_distance", F.lit(0.0)), F.coalesce("moving_time_ms", F.lit(0))
    return live.where("n_points >= 2").withColumns({
        "activity": F.coalesce(F.nullif("activity", F.lit("")), F.lit("bike")), "total_distance": meters, "moving_time_ms": ms,
        "avg_speed": F.when(ms > 0, meters / (ms / 1000)).otherwise(0.0), "pauses": F.when(open_pause, F.array_append(own, end)).otherwise(own),
    }).drop("pause_started_ms")
