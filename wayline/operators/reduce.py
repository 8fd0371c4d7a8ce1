"""Path reduction: per ride, which fixes to keep. The registry is the extension point (id -> kernel over one ride's
arrays, first parameter first); `reduce_rides` runs folds and rounds of splits in their place where it can."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import segment_distance
from . import folds
from .folds import PER_LAT, PER_LNG
from .graph import written

SPEED_PER_METER = 0.25


@dataclass
class Ride:
    x: np.ndarray
    y: np.ndarray
    t: np.ndarray
    v: np.ndarray
    weight: np.ndarray  # cumulative milliseconds
    moved: np.ndarray  # cumulative speed by milliseconds

    @staticmethod
    def of(pdf: pd.DataFrame) -> Ride:
        return Ride.read(*[pdf[c].to_numpy(float) for c in ("lat", "lng", "t_ms", "speed")])

    @staticmethod
    def read(lat: np.ndarray, lng: np.ndarray, t: np.ndarray, v: np.ndarray) -> Ride:
        dt = np.diff(t, prepend=t[:1])
        mean = (v + np.concatenate([v[:1], v[:-1]])) / 2
        k = PER_LNG * np.cos(np.radians(lat.mean())) if len(lat) else 1.0
        return Ride((lng - lng[:1]) * k, (lat - lat[:1]) * PER_LAT, t, v, np.cumsum(dt), np.cumsum(mean * dt))

    def off_line(self, a: int, b: int, i: np.ndarray) -> np.ndarray:
        """Distance of points i from the segment a-b."""
        dx, dy = self.x[b] - self.x[a], self.y[b] - self.y[a]
        size = dx * dx + dy * dy
        px, py = self.x[i] - self.x[a], self.y[i] - self.y[a]
        u = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(len(i))
        return np.hypot(px - u * dx, py - u * dy)

    def mean_speed(self, a: int, b: int) -> float:
        w = self.weight[b] - self.weight[a]
        return (self.moved[b] - self.moved[a]) / w if w > 0 else (self.v[a] + self.v[b]) / 2

    def off_lines(self, a: np.ndarray, b: np.ndarray, i: np.ndarray) -> np.ndarray:
        """As `off_line`, each point with a segment of its own."""
        dx, dy = self.x[b] - self.x[a], self.y[b] - self.y[a]
        size = dx * dx + dy * dy
        px, py = self.x[i] - self.x[a], self.y[i] - self.y[a]
        u = np.where(size != 0, np.clip((px * dx + py * dy) / np.where(size != 0, size, 1.0), 0, 1), 0.0)
        return np.hypot(px - u * dx, py - u * dy)

    def mean_speeds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        w = self.weight[b] - self.weight[a]
        return np.where(w > 0, (self.moved[b] - self.moved[a]) / np.where(w > 0, w, 1.0), (self.v[a] + self.v[b]) / 2)


def _split(ride: Ride, score: Callable[[int, int, np.ndarray], np.ndarray]) -> list[int]:
    """Ranges are split at the point of the largest score above 1."""
    n = len(ride.x)
    keep, todo = {0, n - 1}, [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            i = np.arange(a + 1, b)
            s = score(a, b, i)
            k = int(np.argmax(s))
            if s[k] > 1:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return sorted(keep)


def farthest_point(ride: Ride, tolerance: float) -> list[int]:
    return _split(ride, lambda a, b, i: ride.off_line(a, b, i) / tolerance)


def farthest_point_or_speed(ride: Ride, tolerance: float, speed_per_meter: float = SPEED_PER_METER) -> list[int]:
    return _split(ride, lambda a, b, i: np.maximum(ride.off_line(a, b, i) / tolerance, np.abs(ride.v[i] - ride.mean_speed(a, b)) / (tolerance * speed_per_meter)))


def areas(ride: Ride, most: float = float("inf")) -> list[float]:
    """The area at which each point goes: points go in the order of their triangle's area with their neighbours, never below
    an area already gone. Infinite for the ends and for points that `most` leaves."""
    n = len(ride.x)
    x, y = ride.x.tolist(), ride.y.tolist()
    before, after, version = list(range(-1, n - 1)), list(range(1, n + 1)), [0] * n
    out = [float("inf")] * n

    def triangle(i: int) -> float:
        a, b = before[i], after[i]
        return abs((x[a] - x[i]) * (y[b] - y[i]) - (x[b] - x[i]) * (y[a] - y[i])) / 2

    heap = [(triangle(i), i, 0) for i in range(1, n - 1)]
    heapq.heapify(heap)
    while heap:
        size, i, seen = heapq.heappop(heap)
        if seen != version[i]:
            continue
        if size >= most:
            break
        out[i] = size
        version[i] = -1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                version[j] += 1
                heapq.heappush(heap, (max(size, triangle(j)), j, version[j]))
    return out


def least_area(ride: Ride, area: float) -> list[int]:
    """Points that go at this area or a greater one."""
    return [i for i, size in enumerate(areas(ride, area)) if not size < area]


#: ranges of up to this many points are looked at point by point, as numbers and not as arrays
FEW = 24


def _offs(x: list[float], y: list[float], a: int, b: int, points: range | list[int]) -> list[float]:
    """`off_line` of a few points, by the same steps."""
    xa, ya = x[a], y[a]
    dx, dy = x[b] - xa, y[b] - ya
    size = dx * dx + dy * dy
    out = []
    for i in points:
        px, py = x[i] - xa, y[i] - ya
        u = (px * dx + py * dy) / size if size else 0.0
        if u > 1.0:
            u = 1.0
        elif u < 0.0:
            u = 0.0
        out.append(abs(complex(px - u * dx, py - u * dy)))
    return out


def _corridors(ride: Ride) -> Callable[[float], list[int]]:
    """`corridor` for many tolerances: how far a line's points lie off it is measured once a line."""
    x, y = ride.x.tolist(), ride.y.tolist()
    n = len(x)
    worst: dict[tuple[int, int], float] = {}

    def kept(tolerance: float) -> list[int]:
        keep, a = [0], 0
        for b in range(2, n):
            if (a, b) not in worst:
                off = _offs(x, y, a, b, range(a + 1, b)) if b - a <= FEW else ride.off_line(a, b, np.arange(a + 1, b)).tolist()
                most = max(off, default=0.0)
                worst[a, b] = most if most == most else max((o for o in off if o == o), default=0.0)
            if worst[a, b] > tolerance:
                a = b - 1
                keep.append(a)
        return [*keep, n - 1]

    return kept


def corridor(ride: Ride, tolerance: float) -> list[int]:
    """The line from the last kept point is drawn on while all points between stay within the tolerance."""
    return _corridors(ride)(tolerance)


def spacing(ride: Ride, meters: float) -> list[int]:
    x, y = ride.x.tolist(), ride.y.tolist()
    keep, last = [0], 0
    for i in range(1, len(x) - 1):
        if abs(complex(x[i] - x[last], y[i] - y[last])) >= meters:
            keep.append(i)
            last = i
    return [*keep, len(x) - 1]


def interval(ride: Ride, seconds: float) -> list[int]:
    t = ride.t.tolist()
    keep, last = [0], 0
    for i in range(1, len(t) - 1):
        if t[i] - t[last] >= seconds * 1000:
            keep.append(i)
            last = i
    return [*keep, len(t) - 1]


def data_saver(ride: Ride, meters: float) -> list[int]:
    """As when recording: a fix replaces the last kept one if that lies on the line from the one before it."""
    x, y = ride.x.tolist(), ride.y.tolist()
    keep: list[int] = []
    for i in range(len(x)):
        if len(keep) > 2 and _offs(x, y, keep[-2], i, keep[-1:])[0] < meters:
            keep[-1] = i
        else:
            keep.append(i)
    return keep


REGISTRY: dict[str, tuple[Callable[..., list[int]], float]] = {
    "data_saver": (data_saver, 1.0), "farthest_point": (farthest_point, 3.0), "farthest_point_or_speed": (farthest_point_or_speed, 3.0), "least_area": (least_area, 10.0),
    "corridor": (corridor, 3.0), "spacing": (spacing, 10.0), "interval": (interval, 5.0),
}


def kept_indices(ride: Ride, algorithm: str, value: float) -> list[int]:
    return list(range(len(ride.x))) if len(ride.x) < 3 else sorted(set(REGISTRY[algorithm][0](ride, value)))


#: ranges of more fixes than this are split by Spark in rounds, smaller ones within a task
RANGE_IN_TASK = 20_000


def _score(tolerance: float, by_speed: bool) -> Column:
    """The score of fix p of the range a .. b, as the kernels have it."""
    off = segment_distance(*[F.col(c) for c in ("p.x", "p.y", "a.x", "a.y", "b.x", "b.y")]) / tolerance
    if not by_speed:
        return off
    span = F.col("b.t_ms") - F.col("a.t_ms")
    mean = F.when(span > 0, (F.col("b.moved") - F.col("a.moved")) / span).otherwise((F.col("a.speed") + F.col("b.speed")) / 2)
    return F.greatest(off, F.abs(F.col("p.speed") - mean) / (tolerance * SPEED_PER_METER))


def split_kept(fixes: DataFrame, tolerance: float, by_speed: bool = False, in_task: int = RANGE_IN_TASK) -> DataFrame:
    """(ride_id, seq) that `farthest_point` (or its form by speed) keeps. A round finds the best fix of each range of
    more than `in_task` fixes by a partial aggregate and parts the range there; what is left is split by groups that
    fit a task. Fixes with a null are no fixes and go first."""
    points = folds.planar(fixes, "speed") if by_speed else folds.planar(fixes).withColumn("speed", F.lit(0.0))
    if by_speed:
        w = Window.partitionBy("ride_id").orderBy("seq")
        step = (F.col("speed") + F.lag("speed").over(w)) / 2 * (F.col("t_ms") - F.lag("t_ms").over(w))
        points = points.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("moved", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        points = points.withColumn("moved", F.lit(0.0))
    points = points.select("ride_id", F.struct("seq", "x", "y", "t_ms", "speed", "moved").alias("p"))
    ends = written(points.groupBy("ride_id").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n")))
    kept = [ends.select("ride_id", F.explode(F.array_distinct(F.array("a.seq", "b.seq"))).alias("seq"))]
    ranges = points.join(ends, "ride_id").where("p.seq > a.seq AND p.seq < b.seq").select("ride_id", "p", "a", "b", "n")
    small = [ranges.where(F.col("n") <= in_task)]
    more = not ends.where(F.col("n") > in_task).isEmpty()
    while more:
        large = ranges.where(F.col("n") > in_task)
        best = F.max(F.struct(_score(tolerance, by_speed).alias("score"), (-F.col("p.seq")).alias("first"), "p")).alias("cut")
        cut = written(large.groupBy("ride_id", F.col("a.seq").alias("at")).agg(best).where("cut.score > 1").select("ride_id", "at", F.col("cut.p").alias("cut")))
        kept.append(cut.select("ride_id", "cut.seq"))
        left, right = F.col("p.seq") < F.col("cut.seq"), F.col("p.seq") > F.col("cut.seq")
        parted = large.withColumn("at", F.col("a.seq")).join(cut, ["ride_id", "at"]).where(left | right)
        parted = written(parted.select("ride_id", "p", F.when(left, F.col("a")).otherwise(F.col("cut")).alias("a"), F.when(left, F.col("cut")).otherwise(F.col("b")).alias("b")))
        parted = parted.withColumn("at", F.col("a.seq"))
        sizes = written(parted.groupBy("ride_id", "at").agg(F.count("*").alias("n")))
        ranges = parted.join(sizes, ["ride_id", "at"]).select("ride_id", "p", "a", "b", "n")
        small.append(ranges.where(F.col("n") <= in_task))
        more = not sizes.where(F.col("n") > in_task).isEmpty()

    columns = ("x", "y", "t_ms", "speed", "moved")
    kernel = farthest_point_or_speed if by_speed else farthest_point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rides, seqs, *held in grouped(batches, ["ride_id", "at"], ["ride_id", "seq", *flat]):
            x, y, t, v, moved = (np.concatenate([a[:1], p, b[:1]]).astype(float) for a, p, b in zip(held[:5], held[5:10], held[10:]))
            at = np.array(kernel(Ride(x, y, t, v, t, moved), tolerance)[1:-1], np.int64) - 1
            yield pa.RecordBatch.from_arrays([pa.array(rides[at], pa.int64()), pa.array(seqs[at], pa.int64())], names=["ride_id", "seq"])

    flat = [f"{e}_{c}" for e in "apb" for c in columns]
    rest = functools.reduce(DataFrame.unionByName, [s.select("ride_id", F.col("a.seq").alias("at"), F.col("p.seq").alias("seq"), *[F.col(f"{c[0]}.{c[2:]}").alias(c) for c in flat]) for s in small])
    kept.append(folds.in_order(rest, "ride_id", "at", "seq").mapInArrow(run, "ride_id long, seq long"))
    return functools.reduce(DataFrame.unionByName, kept)


def grouped(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of one key after another, of rows sorted by it. A task holds one key's rows."""
    held: list[list[np.ndarray]] = []
    own: tuple | None = None
    for b in batches:
        keys, values = [b.column(k).to_numpy(zero_copy_only=False) for k in key], [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        new = np.flatnonzero(functools.reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])) + 1
        for i, j in zip([0, *new], [*new, b.num_rows]):
            if i == j:
                continue
            of = tuple(k[i] for k in keys)
            if of != own and held:
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            own = of
            held.append([v[i:j] for v in values])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def reduce_rides(fixes: DataFrame, algorithm: str, value: float | None = None) -> DataFrame:
    """(ride_id, seq) of the kept fixes; those with a null position or time are no fixes. What needs only the last kept
    fixes is a fold over sorted rows, splitting goes by rounds; for the least area, whose order is that of the whole
    ride, a ride is one group: its fixes fit a task, as they fit a device."""
    value = REGISTRY[algorithm][1] if value is None else value
    if algorithm in folds.FOLDS:
        return folds.kept(fixes, algorithm, value)
    if algorithm in ("farthest_point", "farthest_point_or_speed"):
        return split_kept(fixes, value, algorithm == "farthest_point_or_speed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf.iloc[kept_indices(Ride.of(pdf), algorithm, value)][["ride_id", "seq"]]

    known = fixes.select("ride_id", "seq", "lat", "lng", "t_ms", "speed").dropna(subset=["ride_id", "seq", "lat", "lng", "t_ms"])
    return known.groupBy("ride_id").applyInPandas(run, "ride_id long, seq long")


def _splits(ride: Ride, by_speed: bool) -> Callable[[float], list[int]]:
    """What the splitting kernels keep, for many tolerances: where a range is split does not depend on the tolerance, so a
    range is scored once. A range with a second score so near its best that their quotients may be equal is left to the
    kernel, ride and all."""
    n, x, y, v = len(ride.x), ride.x.tolist(), ride.y.tolist(), ride.v.tolist()
    whole = not (np.isnan(ride.x).any() or np.isnan(ride.y).any() or np.isnan(ride.v).any())
    known: dict[tuple[int, int], tuple[float, int] | None] = {}

    def best(a: int, b: int) -> tuple[float, int] | None:
        if (a, b) not in known:
            if whole and b - a <= FEW:
                s = _offs(x, y, a, b, range(a + 1, b))
                if by_speed:
                    mean = float(ride.mean_speed(a, b))
                    s = [max(p, abs(q - mean) / SPEED_PER_METER) for p, q in zip(s, v[a + 1 : b])]  # a power of two: no rounding
                top = max(s)
                k, least = s.index(top) if top == top else 0, top * (1 - 1e-14)
                close = any(least <= p != top for p in s)
            else:
                i = np.arange(a + 1, b)
                s = ride.off_line(a, b, i)
                if by_speed:
                    s = np.maximum(s, np.abs(ride.v[i] - ride.mean_speed(a, b)) / SPEED_PER_METER)
                k = int(np.argmax(s))
                top = float(s[k])
                close = np.count_nonzero(s >= top * (1 - 1e-14)) != np.count_nonzero(s == top)
            known[a, b] = None if close or top != top else (top, a + 1 + k)
        return known[a, b]

    def kept(tolerance: float) -> list[int]:
        keep, todo = {0, n - 1}, [(0, n - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                cut = best(a, b)
                if cut is None:
                    return kept_indices(ride, "farthest_point_or_speed" if by_speed else "farthest_point", tolerance)
                if cut[0] / tolerance > 1:
                    keep.add(cut[1])
                    todo += [(a, cut[1]), (cut[1], b)]
        return sorted(keep)

    return kept


def _areas(ride: Ride) -> Callable[[float], list[int]]:
    """What `least_area` keeps, for many areas: the order in which points go is the same, only where it ends is not."""
    size = areas(ride)
    return lambda area: [i for i, s in enumerate(size) if not s < area]


def keeper(ride: Ride, algorithm: str) -> Callable[[float], list[int]]:
    """`kept_indices` of one ride and algorithm for many parameters, with what these share done once."""
    if len(ride.x) >= 3 and algorithm == "least_area":
        return _areas(ride)
    if len(ride.x) >= 3 and algorithm == "corridor":
        return _corridors(ride)
    if len(ride.x) >= 3 and algorithm in ("farthest_point", "farthest_point_or_speed"):
        return _splits(ride, algorithm == "farthest_point_or_speed")
    return lambda value: kept_indices(ride, algorithm, value)


def _tuned(ride: Ride, algorithm: str, want: int, steps: int = 22) -> tuple[float, list[int]]:
    """The parameter, by bisection of its logarithm, whose kept count is nearest to `want`."""
    low, high = 1e-3, 1e6
    best: tuple[int, float, list[int]] | None = None
    keep = keeper(ride, algorithm)
    for _ in range(steps):
        mid = float(np.sqrt(low * high))
        kept = keep(mid)
        if best is None or abs(len(kept) - want) < best[0]:
            best = (abs(len(kept) - want), mid, kept)
        if len(kept) == want:
            break
        low, high = (mid, high) if len(kept) > want else (low, mid)
    return best[1], best[2]


SCORES = ("mean_off", "p95_off", "max_off", "length_change", "speed_mean", "speed_max", "span_speed_mean", "span_speed_max", "peak_kept")


def scores(ride: Ride, kept: list[int]) -> dict[str, float]:
    """What the kept fixes lose: distance of each fix from the line kept in its place (mean, 95 %, most), change of the
    length as a share, and each fix's speed against that read between the kept ones and against its span's mean (mean,
    most). A kept fix's speed is the mean over half of the spans beside it; `peak_kept` is the highest of these by the
    ride's highest. A ride of fewer than two kept fixes loses nothing."""
    n, at = len(ride.x), np.array(kept)
    if len(kept) < 2:
        return {s: float(s == "peak_kept") for s in SCORES}
    low, high = np.append(at[0], (at[:-1] + at[1:]) // 2), np.append((at[:-1] + at[1:]) // 2, at[-1])
    speed = np.where(high > low, ride.mean_speeds(low, high), ride.v[at])
    off, read, span = np.zeros(n), np.zeros(n), np.zeros(n)
    i, k = np.arange(at[0], at[-1]), np.repeat(np.arange(len(at) - 1), np.diff(at))  # fixes by the span they lie in
    a, b = at[k], at[k + 1]
    off[i] = ride.off_lines(a, b, i)
    gone = ride.t[b] - ride.t[a]
    u = np.where(gone > 0, (ride.t[i] - ride.t[a]) / np.where(gone > 0, gone, 1.0), 0.0)
    read[i] = np.abs(ride.v[i] - speed[k] - (speed[k + 1] - speed[k]) * u)
    span[i] = np.abs(ride.v[i] - ride.mean_speeds(a, b))
    length, left = (np.hypot(np.diff(x), np.diff(y)).sum() for x, y in ((ride.x, ride.y), (ride.x[at], ride.y[at])))
    peak = max(0.0, ride.v.max())
    found = (off.mean(), np.sort(off)[min(n - 1, int(0.95 * n))], off.max(), (left - length) / length if length else 0.0, read.mean(), read.max(), span.mean(), span.max(), max(0.0, speed.max()) / peak if peak else 1.0)
    return dict(zip(SCORES, map(float, found)))


def compare(fixes: DataFrame, share: float = 0.25) -> DataFrame:
    """Every ride by every algorithm, tuned to keep a share of the fixes: kept count and `scores`. A task holds one ride."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rides, *held in grouped(batches, ["ride_id"], ["ride_id", "lat", "lng", "t_ms", "speed"]):
            ride, n, rows = Ride.read(*[h.astype(float) for h in held]), len(rides), []
            for algorithm in REGISTRY:
                _, kept = _tuned(ride, algorithm, max(2, round(n * share)))
                rows.append({"ride_id": int(rides[0]), "algorithm": algorithm, "n": n, "n_kept": len(kept), **scores(ride, kept)})
            yield pa.RecordBatch.from_pylist(rows, schema=_COMPARED)

    known = fixes.select("ride_id", "seq", "lat", "lng", "t_ms", "speed").dropna(subset=["ride_id", "seq", "lat", "lng", "t_ms"])
    return folds.in_order(known, "ride_id", "seq").mapInArrow(run, "ride_id long, algorithm string, n long, n_kept long, " + ", ".join(f"{s} double" for s in SCORES))


_COMPARED = pa.schema([("ride_id", pa.int64()), ("algorithm", pa.string()), ("n", pa.int64()), ("n_kept", pa.int64()), *[(s, pa.float64()) for s in SCORES]])
