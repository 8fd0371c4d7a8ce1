"""Live rides: keyed state per ride, fed by a stream of fixes; the batch twin is operators.tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import written

STATE = "lat double, lng double, t_ms long, n long, distance_m double, max_speed double, silent long"
OUT = "ride_id long, n long, distance_m double, max_speed double, last_ms long, silent long"


def _meters(lat1: float, lng1: float, lat2: float, lng2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 12_742_000 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def live_totals(fixes: DataFrame, silent_ms: int = 3500) -> DataFrame:
    """Running totals per ride, one row per ride and micro-batch: fixes, distance, top speed, silent spells. Fixes
    of a ride arrive in order across batches and are sorted within one."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lat, lng, t, n, distance, top, silent = state.get if state.exists else (0.0, 0.0, 0, 0, 0.0, 0.0, 0)
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if n:
                distance += _meters(lat, lng, r.lat, r.lng)
                silent += int(r.t_ms - t > silent_ms)
            lat, lng, t, n, top = r.lat, r.lng, r.t_ms, n + 1, max(top, r.speed)
        state.update((lat, lng, int(t), n, distance, top, silent))
        yield pd.DataFrame({"ride_id": [key[0]], "n": [n], "distance_m": [distance], "max_speed": [top], "last_ms": [int(t)], "silent": [silent]})

    return fixes.groupBy("ride_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_activity(fixes: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Event-time windows with a watermark: fixes and rides per window. An addition for live boards; fixes later
    than the watermark are dropped."""
    timed = fixes.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.approx_count_distinct("ride_id").alias("rides"))


def replay(spark: SparkSession, fixes: DataFrame, folder: str, slices: int = 4) -> DataFrame:
    """Fixes as a stream: written as files in the order of time, a slice's many files at once. A ride's rows of a slice
    are in one file, and files are read in the order in which they were written, so a micro-batch that takes in the end
    of one slice and the start of the next still has each ride's fixes in order."""
    fixes = written(fixes)  # else each slice works them all out again
    span = fixes.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    step = max(1, (span["hi"] - span["lo"]) // slices + 1)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(slices):  # slices is a parameter, not the data's size
        part = fixes.where((F.col("seq") >= span["lo"] + i * step) & (F.col("seq") < span["lo"] + (i + 1) * step))
        part.repartition(files, "ride_id").write.mode("append").parquet(folder)
    return spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stateful stream over what is there, writing each micro-batch with its number; the last row of each
    ride is its total. A restart from the checkpoint writes a batch again under its number, so none counts twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    rows = spark.read.parquet(path)
    return rows.groupBy("ride_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("ride_id", "batch")]), "batch").alias("x")).select("ride_id", "x.*")
