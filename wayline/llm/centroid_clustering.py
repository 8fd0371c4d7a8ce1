"""Centroid clustering (k-means on whole numbers) by bit planes.

A vector of 64 whole numbers is held as its bit planes: plane p is one unsigned 64-bit word whose bit d is bit p of
component d, in two's complement. So the product of a vector and a centroid is the sum over planes p and q of
weight(p) * weight(q) * popcount(v[p] & c[q]), exact, and so is the squared distance |v|^2 - 2 v.c + |c|^2. The number of
planes follows the table's extremes.

Each round reads the packed table once, sums components by centroid within a task, and adds the tasks' sums by centroid;
only the k centroids pass through the driver. The packed table lies in the shared folder, so that a lost executor costs
the tasks that it ran.

Defined results: vectors that do not have 64 components, or hold a null, NaN or infinity, take no part; rows of one id
are rows of their own; a row without id is clustered but never a first centroid; fewer vectors than k are that many
centroids; an empty table gives an empty result; only the id and vector columns are read. Components beyond 2^27 in
magnitude raise, as squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMS = 64
LARGEST = 1 << 27
ROWS = 2048  # that are compared with all centroids at once


def whole(vec: str, scale: int) -> Column:
    """The components as floor(scale * x), x as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def full(vec: str) -> Column:
    """64 components, none null, NaN or infinite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vec).isNotNull() & (F.size(vec) == DIMS) & F.forall(vec, sound)


def bit_planes(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of 64 whole numbers as n words each; the last plane is the sign's."""
    place = np.uint64(1) << np.arange(DIMS, dtype=np.uint64)
    bits = (x[:, None, :] >> np.arange(n)[None, :, None]) & 1
    return (bits.astype(np.uint64) * place).sum(2, dtype=np.uint64)


def from_planes(planes: np.ndarray) -> np.ndarray:
    bits = (planes[:, :, None] >> np.arange(DIMS, dtype=np.uint64)) & np.uint64(1)
    return (bits.astype(np.int64) * weights(planes.shape[1])[None, :, None]).sum(1)


def weights(n: int) -> np.ndarray:
    w = np.int64(1) << np.arange(n, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dot_products(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All products of the rows of v and c, by weighted popcounts of their planes' intersections."""
    out = np.zeros((len(v), len(c)), np.int64)
    for p, wp in enumerate(weights(v.shape[1])):
        of_plane = np.zeros_like(out)
        for q, wq in enumerate(weights(c.shape[1])):
            of_plane += wq * np.bitwise_count(v[:, p, None] & c[None, :, q]).astype(np.int64)
        out += wp * of_plane
    return out


def nearest(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row (of equal ones the first) and its squared distance."""
    own = lambda x: (from_planes(x) ** 2).sum(1)
    d = own(v)[:, None] - 2 * dot_products(v, c) + own(c)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


def _words(column: pa.Array, n: int) -> np.ndarray:
    """A column of n packed words a row."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(-1, n)


def pack(df: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, planes) of the vectors that take part, written once, and the number of planes (0 for no vector)."""
    rows = df.where(full(vec_col)).select(F.col(id_col).alias("id"), whole(vec_col, scale).alias("x"))
    low, high = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if low is None:
        return rows.select("id", F.lit(None).cast("array<bigint>").alias("planes")).limit(0), 0
    if max(-low, high) > LARGEST:
        raise OverflowError(f"components from {low} to {high}: squared distances would not fit a long")
    n = max(int(low).bit_length(), int(high).bit_length()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
                words = bit_planes(x, n).view(np.int64).reshape(-1)
                planes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(words))
                yield pa.RecordBatch.from_arrays([b.column("id"), planes], names=["id", "planes"])

    kind = df.schema[id_col].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"id {kind}, planes array<bigint>"), "bit-planes"), n


def first_centroids(packed: DataFrame, n: int, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids hash least, in that order; rows of one id by their planes."""
    named = packed.where("id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    rows = named.orderBy("h", "planes").limit(k).select("planes").collect()
    return from_planes(np.array([r[0] for r in rows], np.int64).view(np.uint64).reshape(-1, n))


def assign(packed: DataFrame, n: int, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every packed vector."""
    c = bit_planes(centroids, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                at, d = nearest(_words(part.column("planes"), n), c)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return packed.mapInArrow(run, f"id {packed.schema['id'].dataType.simpleString()}, cluster int, distance bigint")


def moved(packed: DataFrame, n: int, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors becomes the floor of their mean, component by component."""
    c = bit_planes(centroids, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros((len(c), DIMS), np.int64)
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                v = _words(b.slice(k, ROWS).column("planes"), n)
                at, _ = nearest(v, c)
                count += np.bincount(at, minlength=len(c))
                np.add.at(total, at, from_planes(v))
        some = np.flatnonzero(count)
        if len(some):
            cols = [pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, d]) for d in range(DIMS))]
            yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", *(f"s{d}" for d in range(DIMS))])

    sums = packed.mapInArrow(run, "cluster int, n bigint, " + ", ".join(f"s{d} bigint" for d in range(DIMS)))
    out = centroids.copy()
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(f"s{d}").alias(f"s{d}") for d in range(DIMS))).collect():  # k rows at most
        out[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(DIMS)]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the centroids."""
    packed, n = pack(df.select(id_col, vec_col), id_col, vec_col, scale)
    centroids = first_centroids(packed, n, k, seed) if n else np.zeros((0, DIMS), np.int64)
    if not len(centroids):
        kind = packed.schema["id"].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance bigint"), centroids
    for _ in range(rounds):
        centroids = moved(packed, n, centroids)
    return materialize(assign(packed, n, centroids), "clusters"), centroids


def digest(assigned: DataFrame, centroids: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    """Per vector: id, cluster, distance, the cluster's and the whole inertia, the centroid's hash."""
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    spark = assigned.sparkSession
    total = sum(sums.values())
    by = spark.createDataFrame([(c, sums[c], total, hashes[c]) for c in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = assigned.join(F.broadcast(by), "cluster")  # k rows
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
