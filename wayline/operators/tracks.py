"""Operators over position fixes: windows per ride, ordered by seq. All keep to one shuffle by ride_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dbl, finite, flat_distance, haversine, ratio, speed_band


def by_ride():
    return Window.partitionBy("ride_id").orderBy("seq")


def upto():
    return by_ride().rowsBetween(Window.unboundedPreceding, 0)


def whole():
    return Window.partitionBy("ride_id")


def admitted(fixes: DataFrame, limit: float = 20.0) -> DataFrame:
    """The accuracy filter: the first fix of a ride is forced, later ones need a known accuracy within the limit."""
    ok = (F.col("seq") == 0) | F.coalesce(F.col("accuracy") <= limit, F.lit(False))
    clean = lambda c: F.when(finite(F.col(c)), F.col(c))
    return fixes.where(ok).withColumns({"speed": F.when(finite(F.col("speed")) & (F.col("speed") >= 0), F.col("speed")).otherwise(dbl(0)), "altitude": clean("altitude"), "accuracy": clean("accuracy")})


def steps(fixes: DataFrame) -> DataFrame:
    """Each fix with the step that leads to it: pt, plat, plng, pspeed and step_m (0 for the first)."""
    before = {f"p{b}": F.lag(a).over(by_ride()) for a, b in (("lat", "lat"), ("lng", "lng"), ("t_ms", "t"), ("speed", "speed"))}
    out = fixes.withColumns(before)
    return out.withColumn("step_m", F.coalesce(haversine(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), dbl(0)))


def moving(stepped: DataFrame, pauses: DataFrame) -> DataFrame:
    """Steps with step_ms: their time less what pauses take of it. The join is on the ride, with overlap as residue."""
    p = pauses.select(F.col("ride_id").alias("_ride"), "start", "stop")
    on = (F.col("ride_id") == F.col("_ride")) & (F.col("start") < F.col("t_ms")) & (F.coalesce("stop", "t_ms") > F.col("pt"))
    over = F.when(F.col("_ride").isNotNull(), F.least(F.coalesce("stop", "t_ms"), F.col("t_ms")) - F.greatest("start", "pt"))
    off = stepped.join(p, on).groupBy("ride_id", "seq").agg(F.sum(over).alias("_off"))
    out = stepped.join(off, ["ride_id", "seq"], "left")
    return out.withColumn("step_ms", F.coalesce(F.greatest(F.lit(0), F.col("t_ms") - F.col("pt") - F.coalesce("_off", F.lit(0))), F.lit(0))).drop("_off")


def running(moved: DataFrame) -> DataFrame:
    """Cumulative distance and moving time."""
    return moved.withColumns({"cum_m": F.sum("step_m").over(upto()), "cum_ms": F.sum("step_ms").over(upto())})


def elevation_changes(fixes: DataFrame, rows: int = 5) -> DataFrame:
    """Gain and drop per ride of the trailing mean of `rows` finite altitudes."""
    known = fixes.where(finite(F.col("altitude"))).withColumn("smooth", F.avg("altitude").over(by_ride().rowsBetween(-(rows - 1), 0)))
    delta = known.withColumn("d", F.col("smooth") - F.lag("smooth").over(by_ride()))
    return delta.groupBy("ride_id").agg(F.sum(F.greatest(F.coalesce("d", dbl(0)), dbl(0))).alias("gain"), F.sum(F.greatest(-F.coalesce("d", dbl(0)), dbl(0))).alias("drop"))


def totals(moved: DataFrame) -> DataFrame:
    """Per ride: distance, moving time, maximum and average speed."""
    t = moved.groupBy("ride_id").agg(F.count("*").alias("n_fixes"), F.sum("step_m").alias("distance_m"), F.sum("step_ms").alias("moving_ms"), F.greatest(dbl(0), F.max("speed")).alias("max_speed"))
    return t.withColumn("avg_speed", ratio(F.col("distance_m"), F.col("moving_ms") / 1000))


def carried_elevation(fixes: DataFrame) -> DataFrame:
    return fixes.withColumn("elevation", F.coalesce(F.last(F.when(finite(F.col("altitude")), F.col("altitude")), ignorenulls=True).over(upto()), dbl(0)))


def smooth_by_axis(rows: DataFrame, axis: str, value: str, out: str, least: float, share: int = 80) -> DataFrame:
    """Mean over the rows within half a window on the axis, both ends included; the window is the larger of
    `least` and a share of the ride's length."""
    wide = rows.withColumn("_w", F.greatest(dbl(least), F.max(axis).over(whole()) / share)).withColumn("_x", F.col(axis) / F.col("_w"))
    return wide.withColumn(out, F.expr(f"avg({value}) OVER (PARTITION BY ride_id ORDER BY _x RANGE BETWEEN 0.5D PRECEDING AND 0.5D FOLLOWING)")).drop("_w", "_x")


def trailing_speed(ran: DataFrame, window_ms: int = 6000) -> DataFrame:
    """Distance over time since the first fix of the trailing window, which never starts at the fix itself."""
    first = F.min("seq").over(Window.partitionBy("ride_id").orderBy("t_ms").rangeBetween(-window_ms, 0))
    r = ran.withColumn("_from", F.least(first, F.col("seq") - 1))
    start = ran.select("ride_id", F.col("seq").alias("_from"), F.col("cum_m").alias("_m"), F.col("t_ms").alias("_t"))
    r = r.join(start, ["ride_id", "_from"], "left")
    return r.withColumn("trailing_speed", F.coalesce(F.when(F.col("t_ms") > F.col("_t"), (F.col("cum_m") - F.col("_m")) / ((F.col("t_ms") - F.col("_t")) / 1000)), dbl(0))).drop("_from", "_m", "_t")


def gap(max_ms: int = 10_000, max_m: float = 60.0) -> Column:
    return F.coalesce((F.col("t_ms") - F.col("pt") > max_ms) | (F.col("step_m") > max_m), F.lit(False))


def stretches(stepped: DataFrame) -> DataFrame:
    """Steps with a stretch number that a gap raises."""
    return stepped.withColumn("stretch", F.sum(gap().cast("int")).over(upto()))


def trailing_pace(ran: DataFrame, meters: float = 150.0, least: float = 40.0) -> DataFrame:
    """Speed since the last fix of the stretch that lies `meters` behind, or the stretch's first; null below `least`."""
    r = stretches(ran)
    r = r.withColumn("_behind", F.expr(f"max(seq) OVER (PARTITION BY ride_id, stretch ORDER BY cum_m RANGE BETWEEN UNBOUNDED PRECEDING AND {meters}D PRECEDING)"))
    r = r.withColumn("_from", F.coalesce("_behind", F.min("seq").over(Window.partitionBy("ride_id", "stretch"))))
    start = ran.select("ride_id", F.col("seq").alias("_from"), F.col("cum_m").alias("_m"), F.col("t_ms").alias("_t"))
    r = r.join(start, ["ride_id", "_from"])
    d, t = F.col("cum_m") - F.col("_m"), F.col("t_ms") - F.col("_t")
    return r.withColumn("trailing_pace", F.when((d >= least) & (t > 0), d / (t / 1000))).drop("_behind", "_from", "_m", "_t")


def splits(ran: DataFrame, length: float = 100.0, partial_over: float = 1.0) -> DataFrame:
    """Fixed-distance segments: one for every multiple of `length` that a step crosses, timed at the fixes that
    cross, and the rest of the ride as a partial one."""
    r = ran.withColumn("n", F.floor(F.col("cum_m") / length))
    r = r.withColumn("before", F.coalesce(F.lag("n").over(by_ride()), F.lit(0)))
    full = r.where("n > before").select("ride_id", F.explode(F.sequence(F.col("before") + 1, F.col("n"))).alias("segment"), F.col("cum_ms").alias("at_ms"))
    timed = full.withColumn("duration_ms", F.col("at_ms") - F.coalesce(F.lag("at_ms").over(Window.partitionBy("ride_id").orderBy("segment")), F.lit(0)))
    full = timed.select("ride_id", "segment", F.lit(float(length)).alias("distance_m"), "duration_ms", F.lit(False).alias("partial"))
    ends = r.groupBy("ride_id").agg(F.max("n").alias("n"), F.max("cum_m").alias("m"), F.max("cum_ms").alias("ms"), F.max(F.when(F.col("n") > F.col("before"), F.col("cum_ms"))).alias("last_ms"))
    rest = ends.where(F.col("m") - F.col("n") * length > partial_over).select("ride_id", (F.col("n") + 1).alias("segment"), (F.col("m") - F.col("n") * length).alias("distance_m"), (F.col("ms") - F.coalesce("last_ms", F.lit(0))).alias("duration_ms"), F.lit(True).alias("partial"))
    return full.unionByName(rest).withColumn("avg_speed", ratio(F.col("distance_m"), F.col("duration_ms") / 1000))


def split_markers(ran: DataFrame, length: float = 100.0, back: int = 5) -> DataFrame:
    """For every crossed boundary the nearest of the `back` fixes before the crossing one; the last of them wins
    ties, then the earliest."""
    r = ran.withColumn("n", F.floor(F.col("cum_m") / length)).withColumn("before", F.coalesce(F.lag("n").over(by_ride()), F.lit(0)))
    crossed = r.where("n > before").select("ride_id", F.col("seq").alias("at"), F.explode(F.sequence(F.col("before") + 1, F.col("n"))).alias("segment"))
    near = crossed.withColumn("seq", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - back), F.col("at") - 1)))
    near = near.join(ran.select("ride_id", "seq", "cum_m", "lat", "lng"), ["ride_id", "seq"])
    order = Window.partitionBy("ride_id", "segment").orderBy(F.abs(F.col("cum_m") - F.col("segment") * length), (F.col("seq") != F.col("at") - 1).cast("int"), "seq")
    return near.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("ride_id", "segment", "seq", "lat", "lng")


def band_runs(stepped: DataFrame, bands: int = 16) -> DataFrame:
    """Runs of consecutive steps whose mean end speed falls into one band of the ride's top speed."""
    s = stepped.withColumn("top", F.max("speed").over(whole())).where("pt IS NOT NULL")
    s = s.withColumn("band", speed_band((F.col("speed") + F.col("pspeed")) / 2, F.col("top"), bands))
    s = s.withColumn("run", F.sum(F.coalesce((F.col("band") != F.lag("band").over(by_ride())).cast("int"), F.lit(0))).over(upto()))
    return s.groupBy("ride_id", "run", "band").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("step_m").alias("length_m"))


def stable_start(fixes: DataFrame, rows: int = 3, factor: float = 2.0) -> DataFrame:
    """First index from which `rows` fixes are all within a factor of the ride's best accuracy; 0 if there is none
    or fewer than `rows` accuracies are known."""
    best = F.min("accuracy").over(whole())
    known = F.count("accuracy").over(whole())
    f = fixes.withColumns({"_ok": F.coalesce(F.col("accuracy") <= best * factor, F.lit(False)).cast("int"), "_known": known})
    ahead = by_ride().rowsBetween(0, rows - 1)
    f = f.withColumns({"_all": F.min("_ok").over(ahead), "_n": F.count("*").over(ahead)})
    good = (F.col("_all") == 1) & (F.col("_n") == rows) & (F.col("_known") >= rows)
    return f.groupBy("ride_id").agg(F.coalesce(F.min(F.when(good, F.col("seq"))), F.lit(0)).alias("start_seq"))


def bounding_box(fixes: DataFrame, pad: float = 0.12) -> DataFrame:
    b = fixes.groupBy("ride_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    h, w = F.col("n") - F.col("s"), F.col("e") - F.col("w")
    return b.select("ride_id", (F.col("s") - h * pad).alias("south"), (F.col("n") + h * pad).alias("north"), (F.col("w") - w * pad).alias("west"), (F.col("e") + w * pad).alias("east"))


def extremes(fixes: DataFrame, value: str) -> DataFrame:
    """The first fix with the least and with the largest finite value."""
    v = F.when(finite(F.col(value)), F.col(value))
    return fixes.groupBy("ride_id").agg(F.min_by("seq", F.when(v.isNotNull(), F.struct(v, F.col("seq")))).alias("least_seq"), F.max_by("seq", F.when(v.isNotNull(), F.struct(v, -F.col("seq")))).alias("most_seq"))


def neighbour_mean(fixes: DataFrame, value: str, out: str) -> DataFrame:
    return fixes.withColumn(out, F.avg(value).over(by_ride().rowsBetween(-1, 1)))


def slope(fixes: DataFrame, rows: int = 11, spacing: float = 10.0) -> DataFrame:
    """Least-squares slope of the trailing altitudes, laid `spacing` apart; null with fewer than `rows`."""
    w = by_ride().rowsBetween(-(rows - 1), 0)
    x = F.col("seq") * spacing
    n = F.count("altitude").over(w)
    return fixes.withColumn("slope", F.when(n == rows, F.regr_slope(F.col("altitude"), x).over(w)))


def climb(fixes: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Climb and descent with an anchor that moves only on a change of `threshold` or more."""
    heights = F.transform(F.array_sort(F.collect_list(F.when(finite(F.col("altitude")), F.struct("seq", "altitude")))), lambda x: x.altitude)
    g = fixes.groupBy("ride_id").agg(heights.alias("h"))
    start = F.struct(F.element_at("h", 1).alias("anchor"), dbl(0).alias("up"), dbl(0).alias("down"))
    fold = F.aggregate(
        "h", start,
        lambda acc, h: F.when(F.abs(h - acc.anchor) >= threshold, F.struct(h.alias("anchor"), (acc.up + F.greatest(h - acc.anchor, dbl(0))).alias("up"), (acc.down + F.greatest(acc.anchor - h, dbl(0))).alias("down"))).otherwise(acc),
    )
    return g.where(F.size("h") >= 2).withColumn("f", fold).select("ride_id", F.col("f.up").alias("climb"), F.col("f.down").alias("descent"))


def dead_reckoned(stepped: DataFrame, silent_ms: int = 3500, each_ms: int = 250, most: int = 40) -> DataFrame:
    """Estimated positions within silent steps: every each_ms from the last fix on, straight towards where the
    step before pointed, at the last speed; `most` positions a gap, as the outage ends there."""
    s = stepped.withColumns({"_dlat": F.col("lat") - F.col("plat"), "_dlng": F.col("lng") - F.col("plng"), "nt": F.lead("t_ms").over(by_ride())})
    silent = s.where((F.col("nt") - F.col("t_ms") > silent_ms) & F.col("_dlat").isNotNull() & (F.col("step_m") > 0))
    n = F.least(F.lit(most), F.floor((F.col("nt") - F.col("t_ms") - 1) / each_ms)).cast("int")
    e = silent.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))))
    move = F.col("speed") * F.col("k") * each_ms / 1000 / F.col("step_m")
    return e.select("ride_id", "seq", "k", (F.col("t_ms") + F.col("k") * each_ms).alias("t_ms"), (F.col("lat") + F.col("_dlat") * move).alias("lat"), (F.col("lng") + F.col("_dlng") * move).alias("lng"))


def flat_steps(stepped: DataFrame) -> DataFrame:
    return stepped.withColumn("flat_m", F.coalesce(flat_distance(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")), dbl(0)))
