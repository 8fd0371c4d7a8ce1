"""Best pace per section, kept up to date by a stream of laps. The fold is a monoid, so each micro-batch writes its
partial result under its number (a batch that is run again overwrites itself) and reading folds the partials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["section_id", "direction"]


def partial(laps: DataFrame) -> DataFrame:
    order = F.struct("speed", (-F.unix_micros("ride_date")).alias("t"), (-F.col("ride_id")).alias("r"))
    return laps.groupBy(*KEY).agg(F.count("*").alias("passes"), F.min("ride_date").alias("first_date"), F.max("ride_date").alias("last_date"), F.max(order).alias("best"))


def folded(partials: DataFrame) -> DataFrame:
    out = partials.groupBy(*KEY).agg(F.sum("passes").alias("passes"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("best").alias("best"))
    return out.select(*KEY, "passes", "first_date", "last_date", F.col("best.speed").alias("best"), (-F.col("best.r")).alias("best_ride_id"))


def maintain(laps: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what is there and stop; a later call goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    laps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Fold the partials into one, as a table of its own; readers switch to it when it is complete."""
    p = spark.read.parquet(path)
    p.groupBy(*KEY).agg(F.sum("passes").alias("passes"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("best").alias("best")).write.parquet(f"{into}/batch=0")


def current(spark: SparkSession, path: str) -> DataFrame:
    return folded(spark.read.parquet(path))
