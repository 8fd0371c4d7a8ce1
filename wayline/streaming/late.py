"""Rows that come twice, out of order or too late: stretches of a ride as session windows, late rows kept aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stretches(stream: DataFrame, gap_ms: int = 10_000, late_ms: int = 30_000) -> DataFrame:
    """(ride_id, start_ms, last_ms, n, first_seq, last_seq, max_speed): fixes of a ride without a gap of more than
    `gap_ms` between them, each fix (ride_id, seq) once however often it comes. A stretch is given when the watermark, the
    latest time that any fix had less `late_ms`, has passed its end, and rows no later than the watermark are dropped."""
    timed = stream.select("ride_id", "seq", "t_ms", "speed", F.timestamp_millis("t_ms").alias("at")).dropna(subset=["ride_id", "seq", "t_ms"])
    once = timed.withWatermark("at", f"{late_ms} milliseconds").dropDuplicatesWithinWatermark(["ride_id", "seq"])
    runs = once.groupBy("ride_id", F.session_window("at", f"{gap_ms} milliseconds").alias("w"))
    out = runs.agg(F.max("t_ms").alias("last_ms"), F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("speed").alias("max_speed"))
    return out.select("ride_id", F.unix_millis("w.start").alias("start_ms"), "last_ms", "n", "first_seq", "last_seq", "max_speed")


def finished_stretches(rows: DataFrame, gap_ms: int = 10_000) -> DataFrame:
    """The same over a finished table, without a watermark."""
    once = rows.select("ride_id", "seq", "t_ms", "speed").dropna(subset=["ride_id", "seq", "t_ms"]).dropDuplicates(["ride_id", "seq"])
    runs = once.withColumn("at", F.timestamp_millis("t_ms")).groupBy("ride_id", F.session_window("at", f"{gap_ms} milliseconds").alias("w"))
    out = runs.agg(F.max("t_ms").alias("last_ms"), F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("speed").alias("max_speed"))
    return out.select("ride_id", F.unix_millis("w.start").alias("start_ms"), "last_ms", "n", "first_seq", "last_seq", "max_speed")


def sorted_out(base: str, late_ms: int = 30_000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows no later than the watermark go to base/late, the others to base/kept, by micro-batch.

    Spark drops late rows without a word; here they stay, to be counted or merged by a later job. The watermark is that of
    the batches before, from the one row that each leaves in base/marks. A batch that is written again after a failure
    replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = None
        if number:
            mark = spark.read.parquet(f"{base}/marks").where(F.col("batch") < number).agg(F.max("high")).first()[0]
        batch = batch.persist()
        try:
            is_late = F.coalesce(F.col("t_ms") <= (mark - late_ms if mark is not None else 0), F.lit(False))
            batch.where(is_late).write.mode("overwrite").parquet(f"{base}/late/batch={number}")
            batch.where(~is_late).write.mode("overwrite").parquet(f"{base}/kept/batch={number}")
            batch.agg(F.max("t_ms").alias("high")).write.mode("overwrite").parquet(f"{base}/marks/batch={number}")
        finally:
            batch.unpersist()

    return write


def replay(rows: DataFrame, base: str, cuts: list[int], by: str, run: Callable[[DataFrame], None]) -> None:
    """Rows as they come in: for every stretch of the column `by` that `cuts` divide, what has come is written, and `run`
    does one run over the stream of it, from its checkpoint."""
    bounds = [None, *cuts, None]
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        part = rows.where((F.col(by) >= a if a is not None else F.lit(True)) & (F.col(by) < b if b is not None else F.lit(True)))
        part.write.parquet(f"{base}/in/part={k}")
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{base}/in/part=*"))
