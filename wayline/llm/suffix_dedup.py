"""Removal of repeated byte strings by two-stage suffix sorting.

A byte goes if it is covered by a string of `length` bytes that also starts anywhere else. The corpus is not
one array: windows are dealt out by their minimizer, the gram with the least hash in the window, which equal
windows share. A stretch of windows with one minimizer is an occurrence, its bytes a context. Equal contexts are
counted (all their windows repeat); where different contexts share a minimizer, one of each is laid into a block,
and the block's suffixes are sorted in two stages: suffixes smaller than their successors are sorted directly,
the others are induced by scanning the buckets in order; common prefixes of neighbours of `length` bytes or more
mark the windows that repeat. A minimizer with many different contexts (a passage that many documents share) is
spread instead, as no task may have to hold them together: its contexts are cut into pieces of a few windows,
equal pieces are counted by content hash, and pieces that differ about an equal core have their windows counted.

Defined results: null text is empty; rows are told apart by their position of id and text, and rows that repeat
both are documents of their own, so that their text of `length` bytes or more is removed; strings are judged on
the input; matches never cross documents; only the id and text columns are read; an empty table gives an empty
result. Contexts are compared by 64-bit hashes of their bytes together with their minimizer's 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, shuffle_parts, slices, text_bytes


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 24
    block_bytes: int = 96 << 10  # contexts of a block that is suffix-sorted at once
    hot: int = 32  # contexts of one minimizer beyond which its windows are counted instead
    piece: int = 16  # windows of such a context that are compared as one at first


_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict = {"n": 0}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        _powers.update(n=n, up=np.cumprod(np.full(n, _BASE, np.uint64)), down=np.cumprod(np.full(n, _BASE_INVERSE, np.uint64)))
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    up, _ = _power(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])


def substring_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of data[a:b]; equal strings have equal hashes wherever they stand."""
    _, down = _power(len(prefix))
    return mix64((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))


def _window_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the least value (the leftmost) of every w consecutive ones: least running values of blocks of w
    from the left and from the right."""
    n = len(x)
    bits = max(1, int(n - 1).bit_length())
    packed = (x >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def occurrences(data: np.ndarray, offsets: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """(document, lo, hi, off, minimizer hash, context hash): window starts lo .. hi, in their document, share a
    minimizer, at lo + off; their context is bytes lo .. hi + length."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    size = np.diff(offsets)
    if not (size >= p.length).any():
        return none
    prefix = prefix_hashes(data)
    grams = np.arange(len(data) - p.gram + 1)
    at = _window_argmin(substring_hash(prefix, grams, grams + p.gram), p.length - p.gram + 1)
    doc = np.repeat(np.arange(len(size)), np.maximum(size - p.length + 1, 0))
    starts = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(np.maximum(size - p.length + 1, 0))])[:-1] - offsets[:-1], np.maximum(size - p.length + 1, 0))
    place = at[starts]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(first[1:], len(doc)) - 1
    lo, hi, m = starts[first], starts[last], place[first]
    h = substring_hash(prefix, m, m + p.gram)
    c = mix64(substring_hash(prefix, lo, hi + p.length) + (m - lo).astype(np.uint64))
    base = offsets[doc[first]]
    return doc[first], lo - base, hi - base, m - lo, h, c


def two_stage_suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (uint8, its last symbol 0 and least) in the order of at least their first `depth` symbols.

    First stage: suffixes smaller than their successors, sorted directly. Second stage: buckets by first symbol
    are scanned in order; the suffix before each scanned one, if larger than its successor, is the next of its
    own bucket's front part. Within a bucket the front part grows while runs of its symbol are scanned.
    """
    n = len(t)
    step = np.sign(t[1:].astype(np.int16) - t[:-1])
    known = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(known[::-1])[::-1]  # equal symbols compare as the next unequal ones
    smaller = np.zeros(n, bool)
    smaller[:-1] = (nearest < n) & (step[np.minimum(nearest, n - 2)] > 0)
    raw = t.tobytes()
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    by_symbol = t[direct]
    cuts = np.searchsorted(by_symbol, np.arange(257))  # direct is in order of its first symbols
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    front[0].append(np.array([n - 1], np.int64))
    out: list[np.ndarray] = []

    def induce(scanned: np.ndarray, own: int) -> np.ndarray:
        """Deal the predecessors of scanned suffixes to their buckets; those of the same bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[~smaller[before]]
        symbols = t[before]
        for s in np.unique(symbols):
            if s != own:
                front[s].append(before[symbols == s])
        return before[symbols == own]

    for s in range(256):
        part = np.concatenate(front[s]) if front[s] else np.zeros(0, np.int64)
        while len(part):
            out.append(part)
            part = induce(part, s)
        back = direct[cuts[s] : cuts[s + 1]]
        if len(back):
            out.append(back)
            induce(back, s)
    return np.concatenate(out)


def neighbour_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, at most `most`."""
    padded = np.concatenate([t, np.zeros(most, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, most)
    out = np.zeros(len(order), np.int64)
    # most neighbours part early: the first symbols decide, the rest are compared whole
    a, b = order[1:], order[:-1]
    near = np.flatnonzero((padded[a + most // 2] == padded[b + most // 2]) & (padded[a] == padded[b]))
    far = np.setdiff1d(np.arange(len(a)), near, assume_unique=True)
    for some, width in ((far, most // 2 + 1), (near, most)):
        for k in range(0, len(some), 4096):
            i = some[k : k + 4096]
            differ = rows[a[i]][:, :width] != rows[b[i]][:, :width]
            out[i + 1] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def repeated_windows(contexts: list[bytes], spans: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Per context the runs (first, last) of window starts 0 .. span that also start in another context or
    elsewhere in the same one."""
    sizes = np.array([len(c) + 1 for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    t = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    if (t == 0).sum() > len(contexts):  # zero bytes inside: one up, which UTF-8 leaves room for
        t = t + 1
        t[begin[1:] - 1] = 0
    order = two_stage_suffix_array(t, length)
    shared = neighbour_prefixes(t, order, length) >= length
    again = np.zeros(len(t) + 1, bool)
    again[order[shared]] = True
    again[order[:-1][shared[1:]]] = True
    out = []
    for a, span in zip(begin[:-1], spans):
        hit = np.concatenate([[0], again[a : a + span + 1].astype(np.int8), [0]])
        edge = np.diff(hit)
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())))
    return out


_RUNS = "array<struct<a:int,b:int>>"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.xxhash64(F.col(id_col), F.lit("|"), text).alias("key"), F.col(id_col).alias("id"), text.alias("text"))


def find(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, lo, hi): runs of window starts that repeat, by document key (see _keyed)."""
    docs = _keyed(df, id_col, text_col).select("key", "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            data, offsets = text_bytes(part.column("text"))
            doc, lo, hi, off, h, c = occurrences(data, offsets, p)
            key = part.column("key").to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(off, pa.int32()), pa.array(h.astype(np.int64)), pa.array(c.astype(np.int64))], names=["key", "lo", "hi", "off", "h", "c"])

    # most minimizers occur once in all: nothing there repeats, and nothing further is kept of them
    every = materialize(docs.mapInArrow(mark, "key long, lo int, hi int, off int, h long, c long"), "suffix-all")
    again = every.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    seen = materialize(every.join(again.hint("merge"), "h", "left_semi").select("key", "lo", "hi", "off", "h", "c"), "suffix-occurrences")
    contexts = seen.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", "off")).alias("one"))
    contexts = materialize(contexts, "suffix-contexts")
    several = contexts.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    alike = contexts.where("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.hi") - F.col("one.lo")).alias("b"))).alias("runs"))

    # the bytes of one of each context of the minimizers that have several
    asked = contexts.join(several, "h").select(F.col("one.key").alias("key"), F.struct("h", "c", "m", "one.lo", "one.hi", "one.off").alias("ask")).groupBy("key").agg(F.collect_list("ask").alias("asks"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = [(x["h"], x["c"], x["m"], x["hi"] - x["lo"], x["off"], text[x["lo"] : x["hi"] + p.length]) for text, asks in zip(part.column("text").to_pylist(), part.column("asks").to_pylist()) for x in asks]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["h", "c", "m", "span", "off", "bytes"])

    texts = docs.join(asked, "key").mapInArrow(fetch, "h long, c long, m long, span int, off int, bytes binary")
    texts = materialize(texts, "suffix-bytes")

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        amount = 0

        def flush() -> pa.RecordBatch:
            runs = repeated_windows([r[3] for r in held], np.array([r[2] for r in held]), p.length)
            on = [i for i, r in enumerate(runs) if r]
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in on], pa.int64()), pa.array([held[i][1] for i in on], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in runs[i]] for i in on], _RUN_TYPE)], names=["h", "c", "runs"])

        for b in batches:
            for row in zip(*[b.column(k).to_pylist() for k in ("h", "c", "span", "bytes")]):
                if amount > p.block_bytes and row[0] != held[-1][0]:
                    yield flush()
                    held, amount = [], 0
                held.append(row)
                amount += len(row[3])
        if held:
            yield flush()

    parts = shuffle_parts(df.sparkSession, 2)
    sorted_runs = texts.where(F.col("m") <= p.hot).drop("m").repartition(parts, "h").sortWithinPartitions("h", "c").mapInArrow(sort_blocks, f"h long, c long, runs {_RUNS}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces (h, c, a, whole, core, w): windows a, a + 1, .. with their hashes w. Cuts lie at fixed distances
        from the minimizer, so equal windows of two contexts are in pieces of one kind."""
        for b in slices(batches, "bytes", 1 << 20):
            rows = []
            for h, c, span, off, text in zip(*[b.column(k).to_pylist() for k in ("h", "c", "span", "off", "bytes")]):
                prefix = prefix_hashes(np.frombuffer(text, np.uint8))
                a = np.arange(span + 1)
                w = substring_hash(prefix, a, a + p.length).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], np.diff((off - a) // p.piece) != 0]))
                last = np.append(first[1:], span + 1) - 1
                kind = ((off - first) // p.piece).astype(np.uint64)
                whole = mix64(substring_hash(prefix, first, last + p.length) + kind).astype(np.int64)
                middle = off - kind.astype(np.int64) * p.piece  # what all windows of the kind hold, cut short or not
                core = mix64(substring_hash(prefix, middle, middle + p.length - p.piece + 1) + kind).astype(np.int64)
                rows += [(h, c, int(x), wh, co, w[x : y + 1]) for x, y, wh, co in zip(first, last, whole.tolist(), core.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["h", "c", "a", "whole", "core", "w"])

    pieces = materialize(texts.where(F.col("m") > p.hot).mapInArrow(cut, "h long, c long, a int, whole long, core long, w array<long>"), "suffix-pieces")
    twice = pieces.groupBy("whole").agg(F.count("*").alias("n")).where("n > 1").select("whole")
    equal = pieces.join(twice, "whole").select("h", "c", F.array(F.struct("a", (F.col("a") + F.size("w") - 1).alias("b"))).alias("runs"))
    shared = pieces.groupBy("core").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo <> hi").select("core")
    looked = pieces.join(shared, "core", "left_semi").groupBy("whole").agg(F.min(F.struct("h", "c", "a", "w")).alias("x"))
    windows = looked.select("x.h", "x.c", "x.a", F.posexplode("x.w").alias("i", "v"))
    again = windows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    counted = windows.join(again, "v").select("h", "c", F.array(F.struct((F.col("a") + F.col("i")).alias("a"), (F.col("a") + F.col("i")).alias("b"))).alias("runs"))

    found = alike.unionByName(sorted_runs).unionByName(equal).unionByName(counted)
    runs = found.select("h", "c", F.explode("runs").alias("r"))
    return seen.join(runs, ["h", "c"]).select("key", (F.col("lo") + F.col("r.a")).alias("lo"), (F.col("lo") + F.col("r.b")).alias("hi"))


def remove(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, `kept`, the bytes that stay."""
    docs = _keyed(df, id_col, text_col)
    spans = find(df, p, id_col, text_col).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))  # bounded by the document's length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc, text, runs in zip(*[part.column(k).to_pylist() for k in ("id", "text", "runs")]):
                merged: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"] + p.length) for r in runs or ()):
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                stay, at = [], 0
                for lo, hi in merged:
                    stay.append(text[at:lo])
                    at = hi
                kept = b"".join([*stay, text[at:]])
                rows.append((doc, len(text), len(text) - len(kept), len(merged), kept))
            yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)], pa.array([r[4] for r in rows], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    out = docs.join(spans, "key", "left").mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
