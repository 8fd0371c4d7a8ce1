"""Road network operators that are relational: clipping to a tile and marking edges that a track has ridden."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dbl, segment_distance
from .folds import in_order


def _limits(p: Column, d: Column, size: float) -> tuple[Column, Column]:
    """The part of a segment, as shares of its length, between 0 and size on one axis."""
    a, b = F.try_divide(-p, d), F.try_divide(dbl(size) - p, d)
    inside = (p >= 0) & (p <= size)
    none = F.when(inside, dbl(0)).otherwise(dbl(2)), F.when(inside, dbl(1)).otherwise(dbl(-1))
    return F.when(d == 0, none[0]).otherwise(F.least(a, b)), F.when(d == 0, none[1]).otherwise(F.greatest(a, b))


def clipped(segments: DataFrame, size: float = 4096.0) -> DataFrame:
    """Segments (segment_id, ax, ay, bx, by) cut to the square 0 .. size; those outside, or that only touch it, go."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    (x0, x1), (y0, y1) = _limits(F.col("ax"), dx, size), _limits(F.col("ay"), dy, size)
    t0, t1 = F.greatest(dbl(0), x0, y0), F.least(dbl(1), x1, y1)
    s = segments.withColumns({"t0": t0, "t1": t1}).where(F.col("t1") - F.col("t0") > 1e-9)
    at = lambda c, d, t: (F.col(c) + d * F.col(t)).alias
    return s.select("segment_id", at("ax", dx, "t0")("ax"), at("ay", dy, "t0")("ay"), at("ax", dx, "t1")("bx"), at("ay", dy, "t1")("by"))


def retraced(edges: DataFrame, track: DataFrame, reach: float = 20.0, along: float = 0.8, side: float = 64.0) -> DataFrame:
    """(segment_id, ways): bit 1 if a track segment (ax, ay, bx, by) runs along the edge within reach of its middle,
    bit 2 if one runs against it. The middle is met in its cell; track segments are entered in all they may reach."""
    e = edges.withColumns({"mx": (F.col("ax") + F.col("bx")) / 2, "my": (F.col("ay") + F.col("by")) / 2, "ex": F.col("bx") - F.col("ax"), "ey": F.col("by") - F.col("ay")})
    e = e.select("segment_id", "mx", "my", "ex", "ey", F.floor(F.col("mx") / side).alias("_cx"), F.floor(F.col("my") / side).alias("_cy"))
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / side)
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / side)
    t = track.withColumn("_cx", F.explode(F.sequence(lo("ax", "bx"), hi("ax", "bx")))).withColumn("_cy", F.explode(F.sequence(lo("ay", "by"), hi("ay", "by"))))
    m = t.select("ax", "ay", "bx", "by", "_cx", "_cy").join(e, ["_cx", "_cy"]).where(segment_distance(*[F.col(c) for c in ("mx", "my", "ax", "ay", "bx", "by")]) <= reach)
    tx, ty = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    cos = F.try_divide(tx * F.col("ex") + ty * F.col("ey"), F.hypot(tx, ty) * F.hypot("ex", "ey"))
    bit = F.when(cos >= along, 1).when(cos <= -along, 2)
    return m.where(bit.isNotNull()).groupBy("segment_id").agg(F.bit_or(bit).alias("ways"))


def placed_markers(markers: DataFrame, apart: float) -> DataFrame:
    """Markers (group_id, n, x, y) that fit: every tenth first, then every fifth, then the rest, each unless it would
    lie closer than `apart` on both axes to one placed before. A cell of side `apart` takes one marker at most, so a
    task carries only what the drawing area has room for, and each marker is held against nine cells. Markers with a
    null are not placed."""
    tier = F.when(F.col("n") % 10 == 0, 0).when(F.col("n") % 5 == 0, 1).otherwise(2)
    m = markers.select("group_id", "n", F.col("x").cast("double"), F.col("y").cast("double")).dropna().withColumn("tier", tier)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken = None, {}
        for batch in batches:
            groups, placed = [], []
            for g, n, x, y in zip(*[batch.column(c).to_pylist() for c in ("group_id", "n", "x", "y")]):
                if g != group:
                    group, taken = g, {}
                cx, cy = math.floor(x / apart), math.floor(y / apart)
                near = [taken[c] for c in itertools.product((cx - 1, cx, cx + 1), (cy - 1, cy, cy + 1)) if c in taken]
                if all(abs(x - a) >= apart or abs(y - b) >= apart for a, b in near):
                    taken[cx, cy] = (x, y)
                    groups.append(g)
                    placed.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(placed, pa.int64())], names=["group_id", "n"])

    return in_order(m, "group_id", "tier", "n", "x", "y").mapInArrow(place, "group_id long, n long")
