"""Operators along lines: resampling, interpolation, spans, stops, steps, hysteresis folds and tile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import angle_between, dbl, flat_bearing, mercator, ratio


def _ride():
    return Window.partitionBy("ride_id").orderBy("seq")


def resampled(ran: DataFrame, spacing: float = 20.0, value: str = "altitude") -> DataFrame:
    """Positions every `spacing` metres along each ride, blended between the fixes around them."""
    nxt = lambda c: F.lead(c).over(_ride())
    s = ran.select("ride_id", "seq", "lat", "lng", value, "cum_m", nxt("lat").alias("lat2"), nxt("lng").alias("lng2"), nxt(value).alias("v2"), nxt("cum_m").alias("m2")).where("m2 > cum_m")
    first, last = F.ceil(F.col("cum_m") / spacing), F.ceil(F.col("m2") / spacing) - 1
    s = s.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.expr("cast(array() AS array<bigint>)"))))
    f = (F.col("k") * spacing - F.col("cum_m")) / (F.col("m2") - F.col("cum_m"))
    mix = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * f
    return s.select("ride_id", "k", (F.col("k") * spacing).alias("along"), mix("lat", "lat2").alias("lat"), mix("lng", "lng2").alias("lng"), mix(value, "v2").alias(value))


def value_along(ran: DataFrame, asked: DataFrame, value: str) -> DataFrame:
    """Interpolating as-of lookup: asked (ride_id, id, d) gets the value at distance d. Questions are sorted in
    among the fixes, so no range join is needed."""
    rows = ran.select("ride_id", F.col("cum_m").alias("m"), F.col(value).cast("double").alias("v"), F.lit(None).cast("long").alias("id"), F.lit(0).alias("q"), "seq")
    both = rows.unionByName(asked.select("ride_id", F.col("d").alias("m"), F.lit(None).cast("double").alias("v"), "id", F.lit(1).alias("q"), F.lit(-1).cast("long").alias("seq")))
    w = Window.partitionBy("ride_id").orderBy("m", "q", "seq")
    known = F.when(F.col("q") == 0, F.struct("m", "v"))
    both = both.withColumns({"a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "b": F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    f = ratio(F.col("m") - F.col("a.m"), F.col("b.m") - F.col("a.m"))
    blend = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull(), F.col("b.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * f)
    return both.where("q = 1").select("ride_id", "id", blend.alias("value"))


def nearest_on_axis(rows: DataFrame, axis: str, target: Column) -> DataFrame:
    """Per ride the fix with the least distance to the target on the axis, the first on ties."""
    return rows.groupBy("ride_id").agg(F.min_by("seq", F.struct(F.round(F.abs(F.col(axis) - target), 6), F.col("seq"))).alias("seq"))


def span_means(fixes: DataFrame, span: int = 10) -> DataFrame:
    """Time-weighted mean speed of each block of `span` steps from prefix sums; the ends' mean if no time passes."""
    w = _ride()
    s = fixes.withColumns({"dt": F.col("t_ms") - F.lag("t_ms").over(w), "m": (F.col("speed") + F.lag("speed").over(w)) / 2}).where("dt IS NOT NULL")
    s = s.withColumn("block", F.floor((F.col("seq") - 1) / span))
    g = s.groupBy("ride_id", "block").agg(F.sum("dt").alias("dt"), F.sum(F.col("m") * F.col("dt")).alias("mv"), F.avg("m").alias("plain"))
    return g.select("ride_id", "block", F.when(F.col("dt") > 0, F.col("mv") / F.col("dt")).otherwise(F.col("plain")).alias("mean_speed"))


def half_windows(kept: DataFrame) -> DataFrame:
    """Each kept index with the span halfway to its neighbours."""
    w = _ride()
    p, n = F.coalesce(F.lag("seq").over(w), F.col("seq")), F.coalesce(F.lead("seq").over(w), F.col("seq"))
    return kept.select("ride_id", "seq", F.floor((p + F.col("seq")) / 2).alias("lo"), F.floor((F.col("seq") + n) / 2).alias("hi"))


def stops(points: DataFrame) -> DataFrame:
    """Route points (route_id, i, stop, icon, title): the ends are stops, others by their flag or mark; stops are
    numbered in order."""
    w = Window.partitionBy("route_id").orderBy("i")
    end = F.lag("i").over(w).isNull() | F.lead("i").over(w).isNull()
    s = points.withColumn("is_stop", F.when(end, True).otherwise(F.coalesce("stop", F.col("icon").isNotNull() | F.col("title").isNotNull())))
    return s.withColumn("number", F.when(F.col("is_stop"), F.sum(F.col("is_stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def normalized_marks(marks: DataFrame, icons: tuple[str, ...], length: int = 40) -> DataFrame:
    """Unknown icons go, titles are trimmed and cut; a mark with nothing left goes."""
    title = F.substring(F.trim(F.coalesce("title", F.lit(""))), 1, length)
    m = marks.withColumns({"icon": F.when(F.col("icon").isin(*icons), F.col("icon")), "title": F.when(title != "", title)})
    return m.where("icon IS NOT NULL OR title IS NOT NULL")


def shown_with_hysteresis(rows: DataFrame, value: str, show: float, hide: float) -> DataFrame:
    """Shown once the value reaches `show`, until it falls under `hide`: the last decisive value decides."""
    v = F.abs(F.col(value))
    decided = F.when(v >= show, True).when(v < hide, False)
    return rows.withColumn("shown", F.coalesce(F.last(decided, ignorenulls=True).over(_ride().rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def sign_pieces(sampled: DataFrame, spacing: float = 20.0, steep: float = 0.05) -> DataFrame:
    """Climbs: runs of samples whose slope keeps its sign, with their length and mean slope; `steep` ones flagged."""
    w = Window.partitionBy("ride_id").orderBy("k")
    s = sampled.withColumn("slope", (F.lead("altitude").over(w) - F.col("altitude")) / spacing).where("slope IS NOT NULL")
    s = s.withColumn("sign", F.signum("slope")).withColumn("run", F.sum(F.coalesce((F.col("sign") != F.lag("sign").over(w)).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("ride_id", "run").agg(F.min("k").alias("k"), (F.count("*") * spacing).alias("meters"), F.avg("slope").alias("slope"))
    return g.withColumn("steep", F.abs("slope") >= steep)


def turns(sampled: DataFrame, least: float = 30.0) -> DataFrame:
    """Turns between consecutive samples: the change of heading by kind, from slight to a U-turn."""
    w = Window.partitionBy("ride_id").orderBy("k")
    s = sampled.withColumn("h", flat_bearing(F.col("lat"), F.col("lng"), F.lead("lat").over(w), F.lead("lng").over(w)))
    s = s.withColumn("before", F.lag("h").over(w)).withColumn("change", F.pmod(F.col("h") - F.col("before") + 540, dbl(360)) - 180)
    size = angle_between(F.col("h"), F.col("before"))
    kind = F.when(size >= 165, "uturn").when(size >= 135, "sharp").when(size >= 60, "plain").otherwise("slight")
    side = F.when(size >= 165, "").when(F.col("change") < 0, "left").otherwise("right")
    return s.where(size >= least).select("ride_id", "k", kind.alias("kind"), side.alias("side"))


def open_stretches(stepped: DataFrame, max_ms: int = 300_000, least_m: float = 75.0) -> DataFrame:
    """Stretches unbroken by estimated fixes, long or non-positive steps; short stretches are left out."""
    broken = F.col("pt").isNull() | F.col("estimated") | (F.col("t_ms") <= F.col("pt")) | (F.col("t_ms") - F.col("pt") > max_ms)
    s = stepped.withColumn("stretch", F.sum(broken.cast("int")).over(_ride().rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", F.when(broken, dbl(0)).otherwise(F.col("step_m")))
    return s.groupBy("ride_id", "stretch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("m").alias("meters")).where(F.col("meters") >= least_m)


def ridden_tiles(fixes: DataFrame, margin: int = 1) -> DataFrame:
    """Tiles under the fixes and around them. Tiles are made distinct before they are spread."""
    x, y = mercator(F.col("lng"), F.col("lat"))
    own = fixes.select(F.floor(x / 4096).alias("tx"), F.floor(y / 4096).alias("ty")).distinct()
    d = F.sequence(F.lit(-margin), F.lit(margin))
    return own.withColumn("dx", F.explode(d)).withColumn("dy", F.explode(d)).select((F.col("tx") + F.col("dx")).alias("x"), (F.col("ty") + F.col("dy")).alias("y")).distinct()


def corridor_tiles(tiles: DataFrame, ax: float, ay: float, bx: float, by: float, reach: float, limit: int = 200) -> DataFrame:
    """Tiles whose middle lies within reach of a leg, nearest first, at most `limit` (a feature: what is fetched)."""
    from ..functions.columns import segment_distance

    d = segment_distance(F.col("x") + 0.5, F.col("y") + 0.5, dbl(ax), dbl(ay), dbl(bx), dbl(by))
    return tiles.withColumn("distance", d).where(F.col("distance") <= reach).orderBy(F.round("distance", 6), "x", "y").limit(limit)


def tile_catalog(urls: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Tiles by (z, x, y) from their urls: the greatest url of each, hosts by a list."""
    part = lambda i: F.regexp_extract("url", r"^https?://([^/]+)/.*?(\d+)/(\d+)/(\d+)\.\w+$", i)
    u = urls.select("url", part(1).alias("host"), part(2).alias("z"), part(3).alias("x"), part(4).alias("y")).where(F.col("host").isin(*hosts) & (F.col("z") != ""))
    return u.groupBy(*[F.col(c).cast("long").alias(c) for c in ("z", "x", "y")]).agg(F.max("url").alias("url"))


def pace_trend(traced: DataFrame, average: Column, even: float = 0.2235) -> DataFrame:
    gap = F.col("trailing_pace") - average
    return traced.withColumn("trend", F.when(F.col("trailing_pace").isNull() | average.isNull(), "none").when(F.abs(gap) <= even, "even").when(gap > 0, "ahead").otherwise("behind"))


def reached_points(ran: DataFrame, points: DataFrame, reach: float = 30.0) -> DataFrame:
    """Points (ride_id, i, at) along each ride reached in order: point i at the first fix within reach of it, not
    before the point ahead of it was reached."""
    met = ran.join(points, "ride_id").where(F.abs(F.col("cum_m") - F.col("at")) <= reach).groupBy("ride_id", "i").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy("ride_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("seq", F.max("first_seq").over(w))


def eta_seconds(distance: Column, own_ms: Column, own_m: Column, activity: Column) -> Column:
    """Seconds to go: at the ride's own average after a minute and above 1 m/s, else at the activity's usual pace."""
    own = ratio(own_m, own_ms / 1000)
    usual = F.when(activity == "bike", 4.5).when(activity == "kayak", 1.5).otherwise(1.3)
    return distance / F.when((own_ms > 60_000) & (own > 1), own).otherwise(usual)


def band_opacity(distance: Column) -> Column:
    o = F.greatest(dbl(0), 1 - F.pow(distance / 500, dbl(1.4))) * 0.6
    return F.when(o > 0.01, o)


def language_tag(tag: Column) -> Column:
    parts = F.split(F.regexp_replace(tag, "_", "-"), "-")
    return F.when(F.size(parts) > 1, F.concat(F.lower(parts[0]), F.lit("-"), F.upper(F.get(parts, F.lit(1))))).otherwise(F.lower(parts[0]))
