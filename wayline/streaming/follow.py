"""Following a planned line and deciding which prompts are said: folds in the order of a ride's events.

Rows are dealt by ride and sorted; a task carries the state of the ride it is at (one progress index, one time per
kind of prompt), so no ride is held whole, however long. The same functions run on a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADIUS = 6_371_000.0


def _haversine(lat1, lng1, lat2, lng2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * RADIUS * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def _in_order(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(F.xxhash64("ride_id")).sortWithinPartitions(*by)  # as in `folds.in_order`


def track_line(points: DataFrame, line: list[tuple[float, float]], lookahead: float = 500.0, reach: float = 35.0) -> DataFrame:
    """Points (ride_id, seq, lat, lng) on a line of (lat, lng), a planned route's few thousand vertices: distance
    along it, distance from it, whether that is off the route, and the segment the ride has come to.

    Only segments that start at most `lookahead` metres beyond the one last matched are looked at (that one always);
    the nearest, the first on ties, is the match; progress moves only to matches within `reach`. A line of fewer than
    two vertices matches nothing. Rides without a null seq are expected; null positions give null results.
    """
    at = np.array(line, float).reshape(-1, 2)
    begun = np.concatenate([[0.0], np.cumsum(_haversine(at[:-1, 0], at[:-1, 1], at[1:, 0], at[1:, 1]))]) if len(at) else np.zeros(1)
    last = np.searchsorted(begun, begun + lookahead, side="right")  # per segment, the first that is too far ahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ride, progress = None, 0
        for b in batches:
            out: list[tuple] = []
            for r, lat, lng in zip(*[b.column(c).to_pylist() for c in ("ride_id", "lat", "lng")]):
                if r != ride:
                    ride, progress = r, 0
                if lat is None or lng is None or len(at) < 2:
                    out.append((None, None, None, progress))
                    continue
                i = np.arange(progress, max(progress + 1, min(int(last[progress]), len(at) - 1)))
                k = np.cos(np.radians(lat))
                ax, ay = (at[i, 1] - lng) * k, at[i, 0] - lat
                dx, dy = (at[i + 1, 1] - at[i, 1]) * k, at[i + 1, 0] - at[i, 0]
                size = dx * dx + dy * dy
                t = np.where(size > 0, np.clip(-(ax * dx + ay * dy) / np.where(size > 0, size, 1), 0, 1), 0)
                far = _haversine(lat, lng, at[i, 0] + (at[i + 1, 0] - at[i, 0]) * t, at[i, 1] + (at[i + 1, 1] - at[i, 1]) * t)
                j = int(np.argmin(np.round(far, 6)))  # at a vertex two segments are equally far but for rounding
                if far[j] <= reach:
                    progress = int(i[j])
                out.append((float(begun[i[j]] + t[j] * (begun[i[j] + 1] - begun[i[j]])), float(far[j]), bool(far[j] > reach), progress))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.float64(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("ride_id"), b.column("seq"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["ride_id", "seq", "along", "meters", "off_route", "progress"])

    kept = _in_order(points.select("ride_id", "seq", "lat", "lng"), "ride_id", "seq")
    return kept.mapInArrow(run, "ride_id long, seq long, along double, meters double, off_route boolean, progress long")


def rate_limited(events: DataFrame, gap_ms: dict[str, int]) -> DataFrame:
    """Events (ride_id, kind, t_ms, seq) of the kinds in gap_ms, each at least its gap after the one of its ride and
    kind that was let through before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, said = None, 0
        for b in batches:
            let = []
            for key in zip(*[b.column(c).to_pylist() for c in ("ride_id", "kind", "t_ms")]):
                through = key[:2] != own or key[2] - said >= gap_ms[key[1]]
                if through:
                    own, said = key[:2], key[2]
                let.append(through)
            yield b.filter(pa.array(let, pa.bool_()))

    some = events.where(F.col("kind").isin(*gap_ms) & F.col("t_ms").isNotNull())
    return _in_order(some, "ride_id", "kind", "t_ms", "seq").mapInArrow(run, some.schema)


#: fixed values: least time between two of a kind, in milliseconds, and the age at which a prompt is dropped
GAPS = {"reroute": 60_000, "turn_around": 120_000}
STALE_MS = 6_000


def spoken(prompts: DataFrame) -> DataFrame:
    """Of prompts (ride_id, seq, t_ms, kind, key, age_ms) those that are said: none that waited too long; every key of
    a kind once (a turn's key holds its stage, so it is said early and now); rerouting and turning around by rate."""
    fresh = prompts.where(F.col("age_ms") <= STALE_MS)
    w = Window.partitionBy("ride_id", "kind", "key").orderBy("t_ms", "seq")
    once = fresh.where(~F.col("kind").isin(*GAPS)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.unionByName(rate_limited(fresh, GAPS))


def moved(points: DataFrame, meters: float) -> DataFrame:
    """Points (ride_id, seq, lat, lng) at which something that follows the rider is worked out anew: the first of a
    ride, then each that is `meters` or more from the last such one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ride, at = None, (0.0, 0.0)
        for b in batches:
            let = []
            for r, lat, lng in zip(*[b.column(c).to_pylist() for c in ("ride_id", "lat", "lng")]):
                anew = lat is not None and lng is not None and (r != ride or _haversine(at[0], at[1], lat, lng) >= meters)
                if anew:
                    ride, at = r, (lat, lng)
                let.append(bool(anew))
            yield b.filter(pa.array(let, pa.bool_())).select(["ride_id", "seq"])

    return _in_order(points.select("ride_id", "seq", "lat", "lng"), "ride_id", "seq").mapInArrow(run, "ride_id long, seq long")
