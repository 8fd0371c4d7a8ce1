"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over a prime number of slots: an offset and a step, both from its
name. Shards take turns; each claims the first slot in its order that is still free, until none is. A key's
hash gives a slot and the slot its shard, so placing a row is a lookup in a broadcast table of fixed size; when
a shard joins or leaves, few slots change hands.

Defined results: a null key is placed as the empty string; equal keys share a shard, unless a key holds more
than one shard's fair share of the rows and `spread` is asked for: then its rows are dealt over as many salted
keys as it has shares. Other columns pass through; where the input has a column named like one of the two added
ones, place() refuses and other names must be given; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name

TABLE_SIZE = 65_537  # a prime; the bound of what is broadcast


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard's index for every slot."""
    if not is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("size must be prime and at least the number of shards, whose names differ")
    at = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % size


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    return spark.createDataFrame(list(enumerate(build_table(shards, size))), "slot long, shard long")


def place(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, spread: str | None = None, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The input with its slot and shard. spread: a column whose hash deals out the rows of overfull keys."""
    if {slot_col.lower(), shard_col.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {slot_col} or {shard_col}: choose other names")
    on = F.coalesce(F.col(key).cast("string"), F.lit(""))
    salt = F.lit("")
    if spread is not None:
        own, n, ways = (free_name(df, x) for x in ("_key", "_n", "_ways"))
        counts = df.groupBy(on.alias(own)).agg(F.count("*").alias(n))
        total = counts.agg(F.sum(n).alias("_total"))
        # fewer keys than shards can hold more than a fair share, so this side is bounded
        hot = counts.crossJoin(F.broadcast(total)).where(F.col(n) * len(shards) > F.col("_total")).select(own, F.ceil(F.col(n) * len(shards) / F.col("_total")).alias(ways))
        df = df.join(F.broadcast(hot), on == F.col(own), "left")
        salt = F.when(F.col(ways).isNotNull(), F.concat(F.lit("#"), F.pmod(F.xxhash64(spread), F.col(ways)))).otherwise("")
    placed = df.withColumn(slot_col, slot_of(F.concat(on, salt), size))
    placed = placed.drop(own, ways) if spread is not None else placed
    lookup = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))
    return placed.join(F.broadcast(lookup), slot_col)


def write_shards(placed: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 1) -> None:
    """One folder per shard; rows of a shard are dealt over files_per_shard files."""
    deal = F.pmod(F.hash(*[c for c in placed.columns if c != shard_col]), F.lit(files_per_shard))
    name = free_name(placed, "_deal")
    placed.withColumn(name, deal).repartition(F.col(shard_col), F.col(name)).drop(name).write.partitionBy(shard_col).parquet(path)
