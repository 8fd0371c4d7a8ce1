"""Rides while they are recorded: keyed state and event-time timers, and the same fold over a finished table.

Rows (ride_id, t_ms, n, kind, seq, lat, lng, altitude, speed, accuracy) are fixes and the rider's pauses (`kind`: fix, pause,
resume), in the order of t_ms and n within a ride. What comes out is a log: a row for every fix that counts, with the totals up
to it; for every estimated position that bridges an outage; for every split that a fix completes; for every outage, when its
time is up; and for a ride that has been silent for so long that its state goes.

An outage begins `silent_ms` after a fix that no other followed. On a stream a timer tells it, as soon as the watermark has
passed; in a table, or where the next fix is in the same micro-batch, the next row does. The log is the same for every cut
into micro-batches, but for outages and closings that only the passing of time can show.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.stateful_processor import ListState, ValueState

from ..operators.folds import in_order

INPUT = "ride_id long, t_ms long, n long, kind string, seq long, lat double, lng double, altitude double, speed double, accuracy double"
LOG = "ride_id long, kind string, seq long, k long, t_ms long, lat double, lng double, distance_m double, elapsed_ms long, heading double, max_speed double, gain double, drop double"
_LOG = [c.split()[0] for c in LOG.split(", ")]
_INPUT = [c.split()[0] for c in INPUT.split(", ")]


@dataclass(frozen=True)
class Rules:
    accuracy: float = 20.0
    silent_ms: int = 3500
    step_ms: int = 250
    drift_m: float = 50.0
    turn_m: float = 2.0  # a shorter move does not change the heading
    smooth: int = 5  # altitudes of the trailing mean
    split_m: float = 1000.0
    bridge: bool = True  # for activities fast enough
    quiet_ms: int = 86_400_000  # after which a ride's state goes


def meters(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 12_742_000 * math.atan2(math.sqrt(max(0.0, a)), math.sqrt(max(0.0, 1 - a)))


def bearing(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    d = math.radians(lng2 - lng1)
    y = math.sin(d) * math.cos(math.radians(lat2))
    x = math.cos(math.radians(lat1)) * math.sin(math.radians(lat2)) - math.sin(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.cos(d)
    return (math.degrees(math.atan2(y, x)) + 360) % 360


def known(x) -> float | None:
    return float(x) if x is not None and math.isfinite(x) else None


@dataclass
class Ride:
    """A ride's state: plain values, so that it is a state row, and the last few altitudes."""

    begun: bool = False
    start_ms: int = 0
    t_ms: int = 0
    lat: float = 0.0
    lng: float = 0.0
    seq: int = 0
    speed: float = 0.0
    distance_m: float = 0.0
    max_speed: float = 0.0
    gain: float = 0.0
    drop: float = 0.0
    heading: float | None = None
    smooth: float | None = None
    paused_at: int | None = None
    paused_ms: int = 0
    told: bool = False  # the present outage is in the log
    watched: bool = False  # a fix has come since the last pause: only then an outage can begin
    splits: int = 0
    split_ms: int = 0
    altitudes: list = field(default_factory=list)


VALUES = [f.name for f in fields(Ride)][:-1]
STATE = ", ".join(f"{n} {k}" for n, k in zip(VALUES, ["boolean", "long", "long", "double", "double", "long", "double", "double", "double", "double", "double", "double", "double", "long", "long", "boolean", "boolean", "long", "long"]))


def _row(ride_id: int, r: Ride, kind: str, k: int, t: int, lat: float, lng: float, elapsed: int) -> tuple:
    return (ride_id, kind, r.seq, k, t, lat, lng, r.distance_m, elapsed, r.heading, r.max_speed, r.gain, r.drop)


def outage(ride_id: int, r: Ride, rules: Rules) -> list[tuple]:
    """The outage that began after the last fix, if it is not in the log yet."""
    if r.told or not r.watched:
        return []
    r.told = True
    t = r.t_ms + rules.silent_ms
    return [_row(ride_id, r, "outage", 0, t, r.lat, r.lng, t - r.start_ms - r.paused_ms)]


def _bridge(ride_id: int, r: Ride, lat: float, lng: float, t: int, rules: Rules) -> list[tuple]:
    """Estimated positions through an outage, if they end near the fix that ends it; the ride goes on from the last."""
    direct, n = meters(r.lat, r.lng, lat, lng), (t - r.t_ms - rules.silent_ms - 1) // rules.step_ms
    step = r.speed * rules.step_ms / 1000
    if r.heading is None or n < 1 or direct - n * step > rules.drift_m + 0.01 * (n * step + direct):  # no line of that length gets near
        return []
    north, east = step * math.cos(math.radians(r.heading)) / 111_320, step * math.sin(math.radians(r.heading))
    past = abs(r.lat + n * north - lat) * 111_000  # metres to the north or south that the end is off, which no drift eastwards mends
    if past > rules.drift_m + 1 and max(abs(r.lat), abs(r.lat + n * north), abs(lat)) <= 90:
        return []
    way, at = [], (r.lat, r.lng)
    for _ in range(n):
        per_lng = 111_320 * math.cos(math.radians(at[0]))
        at = (at[0] + north, at[1] + (east / per_lng if per_lng else 0.0))  # less than nothing beyond a pole, where latitudes count on
        way.append(at)
    if meters(*at, lat, lng) > rules.drift_m:
        return []
    out, since = [], r.t_ms + rules.silent_ms
    for k, (y, x) in enumerate(way, 1):
        r.distance_m += meters(r.lat, r.lng, y, x)
        r.lat, r.lng = y, x
        out.append(_row(ride_id, r, "estimated", k, since + k * rules.step_ms, y, x, since + k * rules.step_ms - r.start_ms - r.paused_ms))
    return out


def closed(ride_id: int, r: Ride, rules: Rules) -> list[tuple]:
    """The end of a ride that has been quiet for too long: its outage if untold, a closing row, the state as new."""
    out = outage(ride_id, r, rules) if r.paused_at is None else []
    out.append(_row(ride_id, r, "closed", 0, r.t_ms + rules.quiet_ms, r.lat, r.lng, r.t_ms - r.start_ms - r.paused_ms))
    vars(r).update(vars(Ride()))
    return out


def step(ride_id: int, r: Ride, row: tuple, rules: Rules) -> list[tuple]:
    """One row of the input: changes the state, gives the log's rows."""
    if r.begun and row[0] - r.t_ms > rules.quiet_ms:
        return closed(ride_id, r, rules) + step(ride_id, r, row, rules)
    t, kind, seq, lat, lng, altitude, speed, accuracy = row
    if kind == "resume":
        if r.paused_at is not None:
            r.paused_ms, r.paused_at = r.paused_ms + t - r.paused_at, None
        return []
    silent = r.begun and t - r.t_ms > rules.silent_ms
    if kind == "pause":
        out = outage(ride_id, r, rules) if silent else []
        if r.begun and r.paused_at is None:
            r.paused_at, r.watched, r.told = t, False, False
        return out
    if r.paused_at is not None or t < r.t_ms or lat is None or lng is None or r.begun and not (accuracy is not None and accuracy <= rules.accuracy):
        return []
    out = []
    if silent and r.watched:
        out += outage(ride_id, r, rules)
        out += _bridge(ride_id, r, lat, lng, t, rules) if rules.bridge else []
    speed = known(speed)
    speed = speed if speed is not None and speed >= 0 else 0.0
    if r.begun:
        move = meters(r.lat, r.lng, lat, lng)
        r.distance_m += move
        if move >= rules.turn_m:
            r.heading = bearing(r.lat, r.lng, lat, lng)
    else:
        r.begun, r.start_ms = True, t
    r.t_ms, r.lat, r.lng, r.seq, r.speed, r.told, r.watched = t, lat, lng, seq, speed, False, True
    r.max_speed = max(r.max_speed, speed)
    height = known(altitude)
    if height is not None:
        r.altitudes = [*r.altitudes, height][-rules.smooth :]
        smooth = sum(r.altitudes) / len(r.altitudes)
        if r.smooth is not None:
            r.gain, r.drop = r.gain + max(0.0, smooth - r.smooth), r.drop + max(0.0, r.smooth - smooth)
        r.smooth = smooth
    elapsed = t - r.start_ms - r.paused_ms
    out.append(_row(ride_id, r, "fix", 0, t, lat, lng, elapsed))
    while r.distance_m >= (r.splits + 1) * rules.split_m:
        r.splits += 1
        out.append(_row(ride_id, r, "split", r.splits, t, lat, lng, max(0, elapsed - r.split_ms)))
        r.split_ms = elapsed
    return out


def _rows(columns: list[list]) -> Iterator[tuple]:
    """(t_ms, kind, seq, lat, lng, altitude, speed, accuracy); NaN values are none (pandas has them for nulls)."""
    for t, kind, seq, lat, lng, altitude, speed, accuracy in zip(*columns):
        yield t, kind, None if seq is None or seq != seq else int(seq), known(lat), known(lng), altitude, speed, known(accuracy)


_STEP = ["t_ms", "kind", "seq", "lat", "lng", "altitude", "speed", "accuracy"]


def recorded(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The log of finished rides: a task carries one ride's state over sorted rows and holds no ride. Rows without a
    ride, a time or a kind are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ride, at = None, Ride()
        for b in batches:
            out = []
            for ride_id, row in zip(b.column("ride_id").to_pylist(), _rows([b.column(c).to_pylist() for c in _STEP])):
                if ride_id != ride:
                    ride, at = ride_id, Ride()
                out += step(ride_id, at, row, rules)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(_LOG, o)) for o in out], schema=_ARROW)

    clean = rows.select(*_INPUT).dropna(subset=["ride_id", "t_ms", "kind"])
    return in_order(clean, "ride_id", "t_ms", "n").mapInArrow(run, LOG)


_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in LOG.split(", ")])


class Recorder(StatefulProcessor):
    """A value state of the totals, a list state of the last altitudes, one event-time timer: until the outage, then
    until the ride has been quiet for so long that its state goes."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals: ValueState = handle.getValueState("totals", STATE)
        self.heights: ListState = handle.getListState("altitudes", "altitude double")

    def _read(self) -> Ride:
        if not self.totals.exists():
            return Ride()
        return Ride(*self.totals.get(), altitudes=[h[0] for h in self.heights.get()])

    def _write(self, r: Ride, before: list) -> None:
        self.totals.update(tuple(getattr(r, n) for n in VALUES))
        if r.altitudes != before:
            self.heights.put([(h,) for h in r.altitudes])

    def _wait(self, r: Ride) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        watch = r.watched and not r.told and r.paused_at is None
        self.handle.registerTimer(r.t_ms + (self.rules.silent_ms if watch else self.rules.quiet_ms))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["t_ms", "n"])  # one ride's rows of one micro-batch
        r = self._read()
        before, out = r.altitudes, []
        for row in _rows([frame[c].tolist() for c in _STEP]):
            out += step(key[0], r, row, self.rules)
        if r.begun:
            self._write(r, before)
            self._wait(r)
        if out:
            yield pd.DataFrame(out, columns=_LOG)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        r = self._read()
        if expiredTimerInfo.getExpiryTimeInMs() >= r.t_ms + self.rules.quiet_ms:
            out = closed(key[0], r, self.rules)
            self.totals.clear()
            self.heights.clear()
        else:
            out = outage(key[0], r, self.rules) if r.paused_at is None else []
            self._write(r, r.altitudes)
            self._wait(r)
        if out:
            yield pd.DataFrame(out, columns=_LOG)

    def close(self) -> None:
        pass


def recording(stream: DataFrame, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """The log of a stream of rows as `recorded` takes them. Rows later than the watermark are dropped; see
    `streaming.late` for keeping them aside."""
    timed = stream.select(*_INPUT, F.timestamp_millis("t_ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("ride_id").transformWithStateInPandas(Recorder(rules), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(rows: DataFrame, base: str, cuts: list[int], rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """Rows as they come in: one run from the checkpoint for every stretch of time that `cuts` (ms) divide, and what
    the runs wrote. Timers and lists need the RocksDB state store, which is set for these runs."""
    spark = rows.sparkSession
    schema = rows.schema
    bounds = [None, *cuts, None]
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            part = rows.where((F.col("t_ms") >= a if a is not None else F.lit(True)) & (F.col("t_ms") < b if b is not None else F.lit(True)))
            part.write.parquet(f"{base}/in/part={k}")
            _run(spark, schema, base, rules, late)
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return spark.read.schema(LOG).parquet(f"{base}/out")


def _run(spark: SparkSession, schema, base: str, rules: Rules, late: str) -> None:
    """All that has come since the last run, as one job that ends."""
    stream = spark.readStream.schema(schema).parquet(f"{base}/in/part=*")
    query = recording(stream, rules, late).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
