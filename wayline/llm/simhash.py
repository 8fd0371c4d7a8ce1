"""Near copies by 64-bit fingerprints of word shingles, joined by pigeonring filtering.

A fingerprint's bit is set where more than half of the document's shingle hashes have it. Fingerprints at `distance` or
fewer differing bits link. The 64 bits are cut into m = distance + 1 segments on a ring. If two fingerprints link, some
segment begins a chain whose first l segments together differ in no more than l * distance / m bits, for every l: none
in the first, one in the first two, two in three, and so on. (Each prefix of the chain keeps within its share.)

So fingerprints meet by chains of two segments: one side under its own bits, the other also under those with one bit of
the second segment cleared. Pairs that met must hold the longer prefixes' budgets one after the other, and only then are
compared in all 64 bits. Keys that too many fingerprints share get a third segment with its budget, and what is
still large there is compared in blocks. Distinct fingerprints are compared, not documents; and a task returns links
enough to connect what it has found linked, never all pairs.

Defined results: null and empty texts have no words and the fingerprint zero, linked like any other; rows of one id are
one node of the graph; rows without id have no component of their own (null) but connect others; an empty table
gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts, slices
from .components import components

ONE, START = np.uint64(1), np.uint64(60)  # the start lies above the bits of three segments


@dataclass(frozen=True)
class Params:
    span: int = 4
    seed: int = 42
    distance: int = 4
    common: int = 4096  # fingerprints that share a chain of two before it gets a third segment, at least
    most_common: int = 100_000  # chains that get a third segment, at most: the bound of what the driver holds
    block: int = 8192  # fingerprints of a chain of three that are compared with as many at once
    pairs: int = 1 << 21  # compared at a time


def shingle_hashes(text: bytes, p: Params = Params()) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z and the blanks x20, x09 to x0D alone
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= p.span:
        return np.array([digest(joined, p.seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - p.span] + 1])
    return np.fromiter((digest(joined[a:b], p.seed) for a, b in zip(starts.tolist(), ends[p.span - 1 :].tolist())), np.uint64, n - p.span + 1)


def majority(hashes: np.ndarray, step: int = 1 << 18) -> int:
    """The bits that over half of the hashes have."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), step):
        part = hashes[k : k + step]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): every row's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = [majority(shingle_hashes((t or "").encode(), p)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


class Ring:
    """The segments, and the chains that begin at each."""

    def __init__(self, distance: int):
        if not 3 <= distance <= 7:
            raise ValueError("chains of three segments are keys for distances from 3 to 7")
        self.m = distance + 1
        cuts = [64 * k // self.m for k in range(self.m + 1)]
        self.low, self.width = cuts[:-1], [b - a for a, b in zip(cuts[:-1], cuts[1:])]
        self.budget = [(k + 1) * distance // self.m for k in range(self.m)]

    def segment(self, k: int) -> tuple[int, int]:
        """First bit and width of the k-th segment, counted round the ring."""
        return self.low[k % self.m], self.width[k % self.m]

    def mask(self, start: int, n: int) -> np.uint64:
        """The bits of the n segments from this one on."""
        return np.uint64(sum(((1 << w) - 1) << at for at, w in (self.segment(start + k) for k in range(n))))

    def key(self, fp: np.ndarray, start: int, n: int) -> np.ndarray:
        """The bits of n segments from this one on, side by side, with the start above them."""
        key = np.full(len(fp), start, np.uint64) << START
        body = np.zeros(len(fp), np.uint64)
        for k in range(n):
            at, w = self.segment(start + k)
            body = (body << np.uint64(w)) | ((fp >> np.uint64(at)) & np.uint64((1 << w) - 1))
        return key | body


def common_chains(fps: DataFrame, p: Params) -> np.ndarray:
    """The chains of two that too many fingerprints share. At most `most_common`, since m * n rows have no more keys of
    that many rows."""
    ring = Ring(p.distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ring.key(fp, s, 2) for s in range(ring.m)]).view(np.int64))], names=["key"])

    least = max(p.common, -(-ring.m * fps.count() // p.most_common))
    rows = fps.mapInArrow(run, "key bigint").groupBy("key").count().where(F.col("count") > least).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _among(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(keys), bool)
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys


def entries(fps: DataFrame, common: np.ndarray, p: Params, of_common: bool) -> DataFrame:
    """Under which chains a fingerprint meets others.

    (key, side, fp) for chains of two: side 0 has the chain itself, side 1 with one bit cleared. Or, of the
    common chains only, (key, d, fp) with the d bits of the second segment in which fp differs from the key.
    """
    ring = Ring(p.distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1 << 15):
                fp = b.column("fp").slice(k, 1 << 15).to_numpy().view(np.uint64)
                keys, sides, of = [], [], []

                def put(key: np.ndarray, side: int, who: np.ndarray) -> None:
                    keys.append(key), sides.append(np.full(len(key), side, np.int8)), of.append(who)

                for s in range(ring.m):
                    key = ring.key(fp, s, 2)
                    own = _among(key, common)
                    put(key[own == of_common], 0, fp[own == of_common])
                    for bit in range(ring.segment(s + 1)[1]):
                        other, is_set = key ^ (ONE << np.uint64(bit)), (key >> np.uint64(bit)) & ONE == ONE
                        there = _among(other, common)
                        # two rare chains meet by the cleared bit; a rare one goes to the common one; two common ones, by the cleared bit
                        take = there & (~own | is_set) if of_common else ~there & ~own & is_set
                        put(other[take], 1, fp[take])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(of).view(np.int64))], names=["key", "side", "fp"])

    return fps.mapInArrow(run, "key bigint, side tinyint, fp bigint")


def third_segment(rows: DataFrame, p: Params) -> DataFrame:
    """The common chains' entries (key, side, fp) under chains of three: side 0 itself, side 1 within the budget."""
    ring = Ring(p.distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1 << 12):
                part = b.slice(k, 1 << 12)
                two, d, fp = part.column("key").to_numpy().view(np.uint64), part.column("side").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
                keys, sides, of = [], [], []
                for s in range(ring.m):
                    at, w = ring.segment(s + 2)
                    mine = np.flatnonzero(two >> START == np.uint64(s))
                    if not len(mine):
                        continue
                    third = (fp[mine] >> np.uint64(at)) & np.uint64((1 << w) - 1)
                    body = (two[mine] & (ONE << START) - ONE) << np.uint64(w)
                    top = np.uint64(s) << START
                    for n in range(ring.budget[2] + 1):
                        for bits in combinations(range(w), n):
                            flip = np.uint64(sum(1 << x for x in bits))
                            can = np.flatnonzero(d[mine] + n <= ring.budget[2])
                            key = top | body[can] | (third[can] ^ flip)
                            keys.append(key), sides.append(np.full(len(can), 1, np.int8)), of.append(fp[mine[can]])
                            if n == 0:
                                here = can[d[mine[can]] == 0]
                                keys.append(top | body[here] | third[here]), sides.append(np.zeros(len(here), np.int8)), of.append(fp[mine[here]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sides)), pa.array(np.concatenate(of).view(np.int64))], names=["key", "side", "fp"])

    return rows.mapInArrow(run, "key bigint, side tinyint, fp bigint")


def in_blocks(rows: DataFrame, p: Params) -> DataFrame:
    """Entries by key, x and y: of each key with a side 0, every block x of that side beside every block y of side 1."""
    sizes = rows.groupBy("key").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("n0"), F.sum("side").alias("n1")).where("n0 > 0")
    known = rows.join(sizes, "key")
    ways = lambda n: F.ceil(F.col(n) / p.block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("fp"), ways(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), ways(n) - 1))
    left = known.where("side = 0").select("key", own("n0").alias("x"), all_of("n1").alias("y"), "side", "fp")
    right = known.where("side = 1").select("key", all_of("n0").alias("x"), own("n1").alias("y"), "side", "fp")
    return left.unionByName(right)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, ring: Ring) -> np.ndarray:
    """Which pairs link: the chain's longer prefixes first, then all bits."""
    x, at = a ^ b, np.arange(len(a))
    for n in range(3, ring.m):
        mask = np.array([ring.mask(s, n) for s in range(ring.m)], np.uint64)[start[at]]
        at = at[np.bitwise_count(x[at] & mask) <= ring.budget[n - 1]]
    out = np.zeros(len(a), bool)
    out[at[np.bitwise_count(x[at]) <= ring.budget[-1]]] = True
    return out & (x != 0)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the given ones connect: every node with the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        apart = ru != rv
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ru, rv)[apart], np.minimum(ru, rv)[apart])
        while (root[root] != root).any():
            root = root[root]
    mine = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[mine]], nodes[mine]


def links_of(rows: DataFrame, p: Params, by: list[str], within: bool) -> DataFrame:
    """(a, b): links enough to connect the linked pairs of each group. within: side 0 is compared with itself too."""
    ring = Ring(p.distance)

    def search(key: np.ndarray, group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Whole groups, sorted, side 0 first."""
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        end = ends[np.searchsorted(ends, np.arange(len(group)), side="right")]
        left = np.flatnonzero(side == 0)
        first = left + 1
        if not within:
            n1 = np.cumsum(side != 0)
            first = end[left] - (n1[end[left] - 1] - n1[left])
        count = end[left] - first
        left, first, count = left[count > 0], first[count > 0], count[count > 0]
        total = np.cumsum(count)
        starts = (key >> START).astype(np.int64)
        k = 0
        while k < len(left):
            upto = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + p.pairs, side="right")))
            n = count[k:upto]
            i = np.repeat(left[k:upto], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k:upto], n)
            hit = linked(fp[i], fp[j], starts[i], ring)
            if hit.any():
                yield forest(fp[i[hit]], fp[j[hit]])
            k = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rest: int) -> Iterator[pa.RecordBatch]:
            """Search all but the last `rest` rows, which may belong to a group that goes on."""
            cols = [np.concatenate(x) for x in zip(*held)]
            n = len(cols[0]) - rest
            if n:
                key, group, side, fp = (c[:n] for c in cols)
                found = list(search(key, group, side, fp))
                if found:
                    a, b = forest(*(np.concatenate(x) for x in zip(*found)))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            held[:] = [tuple(c[n:] for c in cols)] if rest else []

        number, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by])
            fresh = np.concatenate([[last is None or (of[:, 0] != last).any()], (of[:, 1:] != of[:, :-1]).any(0)])
            group = number + np.cumsum(fresh)
            number, last = int(group[-1]), of[:, -1]
            held.append((batch.column("key").to_numpy().view(np.uint64), group, batch.column("side").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            groups = np.concatenate([h[1] for h in held])
            if len(groups) >= 1 << 16:
                yield from flush(int(len(groups) - np.searchsorted(groups, number)))
        if held:
            yield from flush(0)

    dealt = rows.repartition(shuffle_parts(rows.sparkSession), *by).sortWithinPartitions(*by, "side")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def join(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots): every row's id and fp; links between fingerprints, enough to connect all that links connect;
    and (node, root) of the fingerprints that are linked."""
    rows = materialize(fingerprints(df, p, id_col, text_col), "simhash-rows")
    fps = materialize(rows.select("fp").distinct(), "simhash-fps")
    common = common_chains(fps, p)
    links = links_of(entries(fps, common, p, of_common=False), p, ["key"], within=True)
    if len(common):
        more = materialize(third_segment(entries(fps, common, p, of_common=True), p), "simhash-third")
        links = links.unionByName(links_of(in_blocks(more, p), p, ["key", "x", "y"], within=False))
    links = materialize(links.distinct(), "simhash-links")
    least = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("hi")).where("a <> hi")
    same_id = least.join(rows, "id").select("a", F.col("fp").alias("b")).where("a <> b")  # rows of one id are one node
    return rows, links, materialize(components(links.unionByName(same_id)), "simhash-roots")


def digest(rows: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the least id that links reach)."""
    known = rows.groupBy("fp").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = known.join(of_root, "root").select("fp", "component_id")
    named = rows.join(by_fp, "fp").withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
