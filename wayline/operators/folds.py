"""Folds in the order of a ride's rows: a task carries a small state over sorted rows and holds no ride."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_LAT, PER_LNG = 110540.0, 111320.0

#: one row (x, y, t_ms, seq, is_last) at a time; gives the seqs that are now known to be kept
Fold = Callable[[float, float, float, int, bool], list[int]]


def in_order(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Rows of a key in one task, sorted. Dealt by a hash of the key: Spark drops a shuffle by the key itself above a union
    whose sides are dealt by it, then merges the sides' partitions apart, so that a key comes in two tasks."""
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *by)


def spacing(meters: float) -> Fold:
    """The first fix, each that lies `meters` or more from the last kept one, the last fix."""
    at: tuple[float, float] | None = None

    def step(x: float, y: float, t: float, seq: int, last: bool) -> list[int]:
        nonlocal at
        far = at is None or math.hypot(x - at[0], y - at[1]) >= meters
        if far:
            at = (x, y)
        return [seq] if far or last else []

    return step


def interval(seconds: float) -> Fold:
    """The first fix, each that comes `seconds` or more after the last kept one, the last fix."""
    at: float | None = None

    def step(x: float, y: float, t: float, seq: int, last: bool) -> list[int]:
        nonlocal at
        late = at is None or t - at >= seconds * 1000
        if late:
            at = t
        return [seq] if late or last else []

    return step


def data_saver(meters: float) -> Fold:
    """As when recording: a fix replaces the last kept one if that lies on the line from the one before it. Only the
    last two kept fixes are held, and the older of them is final."""
    held: list[tuple[float, float, int]] = []
    n = 0

    def step(x: float, y: float, t: float, seq: int, last: bool) -> list[int]:
        nonlocal n
        out = []
        if n > 2 and off_line(held[0], (x, y), held[1]) < meters:
            held[1] = (x, y, seq)
        else:
            n += 1
            held.append((x, y, seq))
            if len(held) > 2:
                out.append(held.pop(0)[2])
        return out + [h[2] for h in held] if last else out

    return step


def off_line(a: tuple, b: tuple, p: tuple) -> float:
    """Distance of p from the segment a-b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    px, py = p[0] - a[0], p[1] - a[1]
    size = dx * dx + dy * dy
    u = min(1.0, max(0.0, (px * dx + py * dy) / size)) if size else 0.0
    return math.hypot(px - u * dx, py - u * dy)


def hull(points: list[tuple]) -> list[tuple]:
    """The corners of the points' convex hull."""
    def chain(ordered: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ordered = sorted(set(points))
    return ordered if len(ordered) < 3 else chain(ordered)[:-1] + chain(ordered[::-1])[:-1]


def corridor(meters: float, trim: int = 64) -> Fold:
    """The line from the last kept fix is drawn on while all fixes between stay within `meters` of it. Distance from a
    segment is convex, so the corners of the hull of those fixes stand for all of them."""
    kept_at: tuple[float, float] | None = None
    before: tuple[float, float, int] | None = None
    between: list[tuple] = []
    full = trim

    def step(x: float, y: float, t: float, seq: int, last: bool) -> list[int]:
        nonlocal kept_at, before, between, full
        out = []
        if kept_at is None:
            kept_at = (x, y)
            return [seq]
        if any(off_line(kept_at, (x, y), p) > meters for p in between):
            kept_at, between, full = before[:2], [], trim
            out.append(before[2])
        before = (x, y, seq)
        between.append((x, y))
        if len(between) >= full:
            between = hull(between)
            full = max(trim, 2 * len(between))
        return [*out, seq] if last else out

    return step


FOLDS: dict[str, Callable[[float], Fold]] = {"spacing": spacing, "interval": interval, "data_saver": data_saver, "corridor": corridor}


def planar(fixes: DataFrame, *more: str) -> DataFrame:
    """(ride_id, seq, t_ms, x, y, is_last, *more) of the fixes (ride_id, seq, lat, lng, t_ms, *more): metres from the
    ride's first fix at the scale of its mean latitude. Fixes with a null in one of these are no fixes and go first."""
    f = fixes.select("ride_id", "seq", "lat", "lng", "t_ms", *more).dropna()
    per = f.groupBy(F.col("ride_id").alias("_r")).agg(F.avg("lat").alias("mean"), F.min_by("lat", "seq").alias("lat0"), F.min_by("lng", "seq").alias("lng0"), F.max("seq").alias("last"))
    return f.join(per, F.col("ride_id") == F.col("_r")).select(
        "ride_id", "seq", "t_ms", ((F.col("lng") - F.col("lng0")) * PER_LNG * F.cos(F.radians("mean"))).alias("x"),
        ((F.col("lat") - F.col("lat0")) * PER_LAT).alias("y"), (F.col("seq") == F.col("last")).alias("is_last"), *more,
    )


def kept(fixes: DataFrame, algorithm: str, value: float) -> DataFrame:
    """(ride_id, seq) of the fixes (ride_id, seq, lat, lng, t_ms) that a fold keeps."""
    return kept_planar(planar(fixes), algorithm, value)


def kept_planar(planar: DataFrame, algorithm: str, value: float) -> DataFrame:
    """(ride_id, seq) of the points (ride_id, seq, t_ms, x, y, is_last) that a fold keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ride, step = None, None
        for b in batches:
            rides, seqs = [], []
            for r, seq, t, x, y, last in zip(*[b.column(c).to_pylist() for c in ("ride_id", "seq", "t_ms", "x", "y", "is_last")]):
                if step is None or r != ride:
                    ride, step = r, FOLDS[algorithm](value)
                for s in step(x, y, t, seq, last):
                    rides.append(r)
                    seqs.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(rides, pa.int64()), pa.array(seqs, pa.int64())], names=["ride_id", "seq"])

    return in_order(planar, "ride_id", "seq").mapInArrow(run, "ride_id long, seq long")
