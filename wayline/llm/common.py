"""What the operators of this subpackage share: table reading, shared-folder tables, Arrow slices."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a default, but only if
    driver and executors are one process (tests): machines of a cluster do not share a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or "/tmp/checkpoints/wayline"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write once to the shared folder and reread.

    Cuts the lineage, computes the plan once, and survives the loss of executors: a later task reads the
    files, not an executor's memory. The folder's owner clears it, as with checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession, times: int = 1) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * times


def give_back() -> None:
    """Return freed memory to the system: Python workers are used again by later stages, whose JVM needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_col: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each slice is near max_bytes; one long text stays whole. After the last,
    freed memory goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(n) // max_bytes
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of every text, and the row that each comes from."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (multiply, shift, twice)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = np.uint64(0x9E3779B97F4A7C15)


def hash_words(values: pa.Array) -> np.ndarray:
    """64-bit polynomial hashes of strings, over all their bytes; equal strings have equal hashes."""
    data, offsets = text_bytes(values)
    size = np.diff(offsets)
    if not len(size):
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(int(size.max()) + 1, ODD, np.uint64))
    within = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    full = np.flatnonzero(size)  # reduceat wants no empty stretch
    total = np.zeros(len(size), np.uint64)
    if len(full):
        total[full] = np.add.reduceat(_BYTE[data] * power[within], offsets[:-1][full])
    return mix64(total + size.astype(np.uint64))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an integer array, ascending (by sorting: numpy's hashing is slow on packed pairs)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def sha256_of(col) -> "F.Column":
    return F.sha2(col.cast("binary"), 256)
