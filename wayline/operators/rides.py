"""Operators over ride summaries, laps of road sections, routes and stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dbl, half_up, or_default, ratio, scale

RANK_BUCKETS = 1024
OVERLAP_BLOCK_MS = 7 * 86_400_000


def with_defaults(rides: DataFrame) -> DataFrame:
    """`kind` (null and empty mean bike) and `speed` (the stored average, or distance over moving time)."""
    return rides.withColumns({"kind": or_default(F.col("activity"), "bike"), "speed": F.coalesce("avg_speed", F.try_divide(F.col("total_distance"), F.col("moving_time_ms") / 1000))})


def valid(rides: DataFrame) -> DataFrame:
    return rides.where("date IS NOT NULL AND total_distance >= 0 AND NOT isnan(total_distance) AND total_distance < double('infinity')")


def period_totals(rides: DataFrame, now: Column) -> DataFrame:
    """Totals since the start of now's month and since midnight six days before."""
    month, week = F.date_trunc("month", now), F.date_trunc("day", now) - F.expr("INTERVAL 6 DAYS")
    d, t = F.coalesce("total_distance", dbl(0)), F.coalesce("moving_time_ms", F.lit(0))
    sums = valid(rides).agg(*[
        f for name, since in (("month", month), ("week", week)) for f in (
            F.sum(F.when(F.col("date") >= since, d).otherwise(dbl(0))).alias(f"{name}_distance"),
            F.sum(F.when(F.col("date") >= since, t).otherwise(F.lit(0))).alias(f"{name}_ms"),
            F.sum((F.col("date") >= since).cast("int")).alias(f"{name}_rides"),
        )
    ])
    return sums.withColumn("month_speed", ratio(F.col("month_distance"), F.col("month_ms") / 1000))


def calendar(rides: DataFrame) -> DataFrame:
    return valid(rides).groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n"), F.sum(F.coalesce("total_distance", dbl(0))).alias("distance"), F.sum("moving_time_ms").alias("ms"), F.min_by("id", F.struct("date", "id")).alias("first_id"))


def pace_ranges(rides: DataFrame) -> DataFrame:
    return with_defaults(rides).where("speed > 0").groupBy("kind").agg(F.min("speed").alias("slowest"), F.max("speed").alias("fastest"))


def pace_fraction(rides: DataFrame) -> DataFrame:
    """Where a ride's speed lies in its activity's range; ranges under 0.05 m/s count as equal. The ranges are a row a
    kind, aggregated before they are joined, so rides are not dealt out by their few kinds."""
    r = with_defaults(rides)
    v = F.when(F.col("speed") > 0, F.col("speed"))
    spans = r.groupBy(F.col("kind").alias("_kind")).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    wide = F.col("_high") - F.col("_low")
    out = r.join(spans, F.col("kind").eqNullSafe(F.col("_kind")), "left")
    return out.withColumn("fraction", F.when(wide >= 0.05, (F.col("speed") - F.col("_low")) / wide).otherwise(dbl(0.5))).drop("_kind", "_low", "_high")


def calendar_scale(rides: DataFrame) -> DataFrame:
    """Per day the scaled distance and the distance-weighted pace fraction. The range is one row, joined to all days."""
    w = F.greatest(F.col("total_distance"), dbl(1))
    days = pace_fraction(valid(rides)).groupBy(F.to_date("date").alias("day")).agg(F.sum("total_distance").alias("distance"), (F.sum(F.col("fraction") * w) / F.sum(w)).alias("pace"))
    span = days.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    return days.crossJoin(F.broadcast(span)).select("day", scale(F.col("distance"), F.col("lo"), F.col("hi")).alias("colour"), "pace")


def bars(rides: DataFrame) -> DataFrame:
    span = rides.agg(F.min("total_distance").alias("lo"), F.max("total_distance").alias("hi"))
    return pace_fraction(rides).crossJoin(F.broadcast(span)).select("id", ratio(F.col("total_distance"), F.col("hi")).alias("length"), scale(F.col("total_distance"), F.col("lo"), F.col("hi")).alias("colour"), "fraction")


def month_bounds(rides: DataFrame, now: Column) -> DataFrame:
    m, cur = F.date_trunc("month", "date"), F.date_trunc("month", now)
    return valid(rides).agg(F.least(F.min(m), cur).alias("first"), F.greatest(F.max(m), cur).alias("last"), F.coalesce(F.max(m), cur).alias("shown"))


def route_averages(rides: DataFrame) -> DataFrame:
    return rides.where("route_id IS NOT NULL AND moving_time_ms > 0").groupBy("route_id").agg((F.sum("total_distance") / (F.sum("moving_time_ms") / 1000)).alias("speed"), F.count("*").alias("n"))


def nearest_rank(values: DataFrame, key: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """sorted[min(n - 1, floor(q n))] per key, by counts of equal values and prefix sums.

    Values are counted, dealt into `RANK_BUCKETS` even buckets of the key's range, and only bucket counts are summed up in
    order; the bucket that holds a rank is then summed up by value. So one key's values are spread over as many tasks
    as there are buckets, however few keys there are.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_c"))
    span = counted.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    with_span = counted.join(span.withColumnsRenamed({k: f"_k_{k}" for k in key}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]).drop(*[f"_k_{k}" for k in key])
    share = F.try_divide((F.col(value) - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")).cast("double"))
    placed = with_span.withColumn("_b", F.least(F.lit(RANK_BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * RANK_BUCKETS)))
    sums = placed.groupBy(*key, "_b").agg(F.sum("_c").alias("_m"))
    sums = sums.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))  # RANK_BUCKETS rows a key
    wanted = sums.join(span.select(*[F.col(k).alias(f"_k_{k}") for k in key], "_n"), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]).drop(*[f"_k_{k}" for k in key])
    rank = lambda q: F.least(F.col("_n") - 1, F.floor(F.col("_n") * q))
    asked = wanted.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), rank(q).alias("rank")) for i, q in enumerate(shares)])))
    asked = asked.where((F.col("_q.rank") < F.col("_upto")) & (F.col("_q.rank") >= F.col("_upto") - F.col("_m")))
    asked = asked.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_b").alias("_kb"), F.col("_q.i").alias("_i"), (F.col("_q.rank") - F.col("_upto") + F.col("_m")).alias("_rank"))
    near = placed.select(*key, "_b", value, "_c").join(asked, [*[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key], F.col("_b") == F.col("_kb")])
    w = Window.partitionBy(*key, "_i").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = near.withColumn("_upto", F.sum("_c").over(w)).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return found.groupBy(*key).agg(*[F.max(F.when(F.col("_i") == i, F.col(value))).alias(f"q{round(q * 100):02d}") for i, q in enumerate(shares)])


def newest_first(rides: DataFrame, limit: int | None = None) -> DataFrame:
    out = rides.orderBy(F.desc_nulls_last("date"), F.desc("id"))
    return out.limit(limit) if limit else out


def merge_candidates(rides: DataFrame, around_ms: Column, count: int = 20) -> DataFrame:
    """The rides nearest in time, oldest first."""
    return rides.orderBy(F.abs(F.col("start_ms") - around_ms), "id").limit(count).orderBy("start_ms", "id")


def merged(rides: DataFrame, group: str) -> DataFrame:
    """Rides merged per group: sums, and the earliest ride's date and activity; the route only if all share it."""
    first = F.struct("start_ms", "id")
    return rides.groupBy(group).agg(
        F.count("*").alias("n"), F.sum("total_distance").alias("distance"), F.sum("moving_time_ms").alias("ms"), F.min_by("id", first).alias("first_id"), F.min_by("activity", first).alias("activity"),
        F.when(F.countDistinct(F.coalesce("route_id", F.lit(-1))) == 1, F.min("route_id")).alias("route_id"), F.max("end_ms").alias("end_ms"),
    )


def overlaps(rides: DataFrame, group: str) -> DataFrame:
    """Per group whether a ride starts before the one before it (by start) has ended.

    Rides are held against the one before within blocks of `OVERLAP_BLOCK_MS` of a group's time, and the first of each
    block against the last of the block before that has any, one row a block: so a few groups are many tasks.
    """
    r = rides.select(group, "start_ms", "end_ms", "id").withColumn("_block", F.floor(F.col("start_ms") / OVERLAP_BLOCK_MS))
    w = Window.partitionBy(group, "_block").orderBy("start_ms", "id")
    r = r.withColumns({"_prev": F.lag("end_ms").over(w), "_first": F.row_number().over(w) == 1})
    hit = F.coalesce(F.col("start_ms") < F.col("_prev"), F.lit(False))
    order = F.struct("start_ms", "id")
    blocks = r.groupBy(group, "_block").agg(F.sum((~F.col("_first") & hit).cast("int")).alias("_n"), F.min(F.when(F.col("_first"), F.col("start_ms"))).alias("_start"), F.max_by("end_ms", order).alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(group).orderBy("_block"))
    b = blocks.withColumn("_n", F.col("_n") + F.coalesce(F.col("_start") < before, F.lit(False)).cast("int"))
    return b.groupBy(group).agg((F.sum("_n") > 0).alias("overlap"), F.sum("_n").alias("n_overlaps"))


def year_dividers(rides: DataFrame) -> DataFrame:
    """The newest ride of each year: where a list sorted newest first shows the year. No global window is needed."""
    return valid(rides).groupBy(F.year("date").alias("year")).agg(F.max_by("id", F.struct("date", "id")).alias("id"), F.count("*").alias("n"))


def natural_key(rides: DataFrame) -> Column:
    return F.concat_ws("|", "start_ms", half_up(F.coalesce(F.col("total_distance"), dbl(0))).cast("string"))


def import_new(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rides whose natural key is new, the first of each key."""
    seen = existing.select(natural_key(existing).alias("_k")).distinct()
    fresh = incoming.withColumn("_k", natural_key(incoming)).join(seen, "_k", "left_anti")
    first = Window.partitionBy("_k").orderBy("id")
    return fresh.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_k", "_r")


def reconcile(rides: DataFrame, summaries: DataFrame) -> DataFrame:
    """(id, action): summaries to insert and orphans to delete."""
    r, s = rides.select("id"), summaries.select("id")
    return r.join(s, "id", "left_anti").withColumn("action", F.lit("insert")).unionByName(s.join(r, "id", "left_anti").withColumn("action", F.lit("delete")))


def pending(rides: DataFrame) -> DataFrame:
    return rides.where(~F.coalesce(F.col("pace_mapped"), F.lit(False)))


def best_pace(laps: DataFrame, key: list[str]) -> DataFrame:
    """The best-pace fold per section: passes, first and last date, best speed with the earliest ride on ties, and
    the earliest known grade. A monoid, so partial aggregates combine on the map side."""
    order = F.struct(F.col("ride_date"), F.col("ride_id"))
    early = F.struct((-F.unix_micros("ride_date")).alias("t"), (-F.col("ride_id")).alias("r"))
    return laps.groupBy(*key).agg(
        F.count("*").alias("passes"), F.min("ride_date").alias("first_date"), F.max("ride_date").alias("last_date"), F.max("speed").alias("best"),
        F.max_by("ride_id", F.struct("speed", early)).alias("best_ride_id"), F.min("meters").alias("meters"), F.min(F.when(F.col("grade").isNotNull(), F.struct(order.alias("o"), "grade"))).getField("grade").alias("grade"),
    )


def flat_twins(sections: DataFrame, flat: float = 0.02) -> DataFrame:
    """Sections ridden in two directions become one where both are flat: passes add up, the better best stays."""
    is_flat = F.coalesce(F.abs(F.col("grade")) <= flat, F.lit(False))
    s = sections.withColumn("twin", F.when(is_flat, F.lit("both")).otherwise(F.col("direction")))
    return s.groupBy("section_id", "twin").agg(F.sum("passes").alias("passes"), F.max("best").alias("best"), F.max_by("best_ride_id", F.struct("best", -F.col("best_ride_id"))).alias("best_ride_id"), F.count("*").alias("n"))


def group_mode(rows: DataFrame, key: str) -> DataFrame:
    """Counts per key and whether it is the most common (the least key on ties); the counts are few."""
    c = rows.groupBy(key).agg(F.count("*").alias("n"))
    top = c.agg(F.max_by(key, F.struct("n", F.lit(0))).alias("_x"), F.max("n").alias("_n"))
    lead = c.join(F.broadcast(top.select("_n")), F.col("n") == F.col("_n")).agg(F.min(key).alias("_top"))
    return c.crossJoin(F.broadcast(lead)).select(key, "n", (F.col(key) == F.col("_top")).alias("most_common"))


def segment_bars(segments: DataFrame) -> DataFrame:
    """Bar width in percent and colour per full segment of a ride."""
    w = Window.partitionBy("ride_id")
    fast, slow = F.greatest(F.max("avg_speed").over(w), dbl(0.0001)), F.min("avg_speed").over(w)
    return segments.select("ride_id", "segment", F.greatest(dbl(2), F.col("avg_speed") / fast * 100).alias("width"), F.when(fast - slow > 0.01, (F.col("avg_speed") - slow) / (fast - slow)).otherwise(dbl(1)).alias("colour"))


def preferences(rows: DataFrame, domains: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """key, value with every known key: values outside a key's domain, and missing keys, take the default."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(k, list(d), v) for k, (d, v) in domains.items()], "key string, domain array<string>, fallback string")
    return known.join(rows, "key", "left").select("key", F.when(F.array_contains("domain", F.col("value")), F.col("value")).otherwise(F.col("fallback")).alias("value"))


def checkpoint_overlay(chunks: DataFrame) -> DataFrame:
    """Chunks (ride_id, start, points) laid over one another: a later start wins at each index."""
    laid = chunks.select("ride_id", "start", F.posexplode("points").alias("p", "point")).withColumn("idx", F.col("start") + F.col("p"))
    return laid.groupBy("ride_id", "idx").agg(F.max_by("point", "start").alias("point"))
