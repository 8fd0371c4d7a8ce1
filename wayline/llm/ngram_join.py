"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. Shingles are XOR-hashed into a bit sketch: each toggles one
bit, so the Hamming distance of two sketches never exceeds the sets' symmetric difference. At a similarity of J
that difference is at most (a + b)(1 - J)/(1 + J) for sizes a and b, so if a size band's sketch has more parts
than that, two linked documents agree on a whole part (pigeonhole). Parts are joined by their content; of a
document's parts that hold anything only as many are joined as the bound needs, plus one: those with the most
shingles, whose content is the rarest. (Any order by content does: before the first part that both agree on, either
has only parts that differ.) A set with too few parts joins single shingles as well, by the same rule. Pairs that
met are filtered by the Hamming distance of a second sketch, as wide as the set is large, and verified on whole sets.

Equal sets become one node first. A group that shares a part never emits all its pairs: small groups (at most
`small` nodes) do, larger ones emit a star, and once its links are known only pairs of nodes that are still in
different components are compared, in blocks, by sketch. So every link between different sets either is
verified or joins two nodes that are already connected.

Defined results: null or empty texts, and texts of blanks, have the empty set and link with nothing; fewer words
than a shingle's make one shingle; ids may repeat (rows of one id are one node of the graph) and may be null
(such rows are their own component, null); only the id and text columns are read; an empty table gives an empty
result. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD, free_name, hash_words, materialize, mix64, shuffle_parts, slices, text_bytes, words_of
from .components import components

LEAST_BITS = 256  # of the second sketch
KEY_BYTES = 14  # of a packed key


@dataclass(frozen=True)
class Params:
    span: int = 5
    share: tuple[int, int] = (80, 100)  # linked: share[1] * intersection >= share[0] * union
    band: float = 1.5
    small: int = 8
    block: int = 1024  # nodes of a large group that are compared with as many others at once
    star: int = 512  # members of a star that are verified together
    forest_keys: int = 3  # large groups of a node (those with the least keys) that are searched for spanning pairs first
    range_bytes: int = 32 << 20  # packed keys that one task sorts


def shingle_sets(text: pa.Array, span: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles."""
    words, rows = words_of(pc.ascii_lower(pc.fill_null(text, "")))
    coded = words.dictionary_encode()
    h = hash_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    at = np.searchsorted(rows, np.arange(len(text) + 1))
    windows = h.copy()
    n = max(0, len(h) - span + 1)
    for k in range(1, span):
        windows[:n] = mix64(windows[:n] * ODD + h[k : n + k])
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= span:
            x = np.sort(windows[a : b - span + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            x = h[a : a + 1] + np.uint64(b - a)
            for k in range(a + 1, b):
                x = mix64(x * ODD + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """The number of a set: equal sets have equal numbers."""
    return int(mix64(np.array([mix64(s).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def sketch_bits(n: int) -> int:
    """The second sketch's width for a set of n: the power of two from 4 n on, so that few of the shingles in which two
    sets differ fall on one bit and the distance stays near the true one."""
    return max(LEAST_BITS, 1 << max(0, 4 * n - 1).bit_length())


def parity_sketch(s: np.ndarray) -> bytes:
    width = sketch_bits(len(s))
    bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows of 64-bit words) of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def hamming_bound(a, b, share: tuple[int, int]):
    """The largest symmetric difference of linked sets of sizes a and b (scalars or arrays)."""
    low, high = share
    both = a + b
    least = -(-(low * both) // (low + high))  # the intersection is this at least
    return both - 2 * least


class Bands:
    """Size bands; a pair belongs to the band of its smaller set."""

    def __init__(self, p: Params):
        self.p, self.starts = p, [1]

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.p.band)))
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    @lru_cache(maxsize=None)
    def parts(self, band: int) -> int:
        low, high = self.p.share
        top = self.starts[band + 1] - 1
        most = int(hamming_bound(top, np.arange(top, high * top // low + 1), self.p.share).max())
        return int(1.15 * (most + 1)) + 3

    @lru_cache(maxsize=1 << 16)
    def tags(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(band, parts, parts to join) for every band that a set of this size takes part in."""
        low, high = self.p.share
        out = []
        self.band(high * n // low + 1)
        for t in range(self.band(-(-low * n // high)), self.band(n) + 1):
            partners = np.arange(-(-low * n // high), high * n // low + 1)
            small = np.minimum(partners, n)
            partners = partners[(small >= self.starts[t]) & (small < self.starts[t + 1])]
            if len(partners):
                out.append((t, self.parts(t), int(hamming_bound(n, partners, self.p.share).max()) + 1))
        return tuple(out)


def part_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The contents of the parts that a set is joined by, as 64-bit keys. s is sorted, so parts are runs."""
    out = []
    for tag, parts, need in bands.tags(len(s)):
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.bitwise_xor.reduceat(mix64(s & np.uint64((1 << 48) - 1)), first)  # the toggled bits of a part 2^48 wide
        salt = mix64(part[first] + np.uint64(tag << 40))
        held = np.diff(np.append(first, len(s)))
        keys = mix64(content ^ salt)[np.argsort(-held, kind="stable")[:need]]
        if len(first) < need:  # two such sets of a band may differ in all their parts
            keys = np.append(keys, mix64(mix64(s[:need]) ^ mix64(np.array([(tag << 40) + (1 << 39)], np.uint64))))
        out.append(keys)
    return np.concatenate(out)


_ENTRY = np.dtype([("key", "<u4"), ("more", "<u2"), ("node", "<i8")])


def nodes(df: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n_shingles, node (null for the empty set) and its second sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), p.span)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([parity_sketch(s) if len(s) else None for s in sets], pa.binary())],
                names=["id", "n_shingles", "node", "sketch"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, node long, sketch binary")


def meetings(df: DataFrame, p: Params, text_col: str, n_shingles: int) -> DataFrame:
    """(key, a, b, n): pairs of nodes that share a part. key is null but for members a of large groups (of n nodes),
    whose pairs are not all listed.

    Keys are dealt out by range, packed: one row a task and range, not one a key. n_shingles, of the whole table,
    gives the ranges' number: about every third shingle makes a key.
    """
    ranges = max(shuffle_parts(df.sparkSession, 2), -(-n_shingles * KEY_BYTES // (3 * p.range_bytes)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, held, amount = Bands(p), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, of = np.concatenate([k for k, _ in held]), np.concatenate([np.full(len(k), n, np.int64) for k, n in held])
            to = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            order = np.argsort(to, kind="stable")
            entry = np.empty(len(keys), _ENTRY)
            entry["key"], entry["more"], entry["node"] = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16), of
            entry, to = entry[order], to[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(to)) + 1
            starts = [0, *cuts]
            yield pa.RecordBatch.from_arrays([pa.array(to[starts], pa.int32()), pa.array([x.tobytes() for x in np.split(entry, cuts)], pa.binary())], names=["r", "packed"])

        for part in slices(batches, "text"):
            for s in shingle_sets(part.column("text"), p.span):
                if len(s):
                    held.append((part_keys(s, bands), node_of(s)))
                    amount += len(held[-1][0])
                    if amount > 2_000_000:
                        yield from flush()
                        held, amount = [], 0
        if held:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        entry = np.frombuffer(b"".join(x.as_py() for x in table.column("packed")), _ENTRY)
        key = entry["key"].astype(np.int64) | (entry["more"].astype(np.int64) << 32)
        order = np.lexsort((entry["node"], key))
        key, node = key[order], entry["node"][order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[fresh], node[fresh]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        a, b = [], []
        for n in range(2, p.small + 1):
            at = first[size == n]
            for i in range(n):
                for j in range(i + 1, n):
                    a.append(node[at + i])
                    b.append(node[at + j])
        large = np.flatnonzero(size > p.small)
        mine = np.repeat(np.isin(np.arange(len(first)), large), size)
        star = np.repeat(node[first], size)
        a.append(star[mine & (node != star)])
        b.append(node[mine & (node != star)])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        n, m = pairs.shape[1], int(mine.sum())
        return pa.table({
            "key": pa.array(np.concatenate([np.zeros(n, np.int64), key[mine] + 1]), mask=np.arange(n + m) < n),
            "a": pa.array(np.concatenate([pairs[0], node[mine]])),
            "b": pa.array(np.concatenate([pairs[1], np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
            "n": pa.array(np.concatenate([np.zeros(n, np.int64), np.repeat(size, size)[mine]]), mask=np.arange(n + m) < n),
        })

    packed = df.select(F.col(text_col).alias("text")).mapInArrow(pack, "r int, packed binary")
    return packed.groupBy("r").applyInArrow(meet, "key long, a long, b long, n long")


def _near(pairs: DataFrame, known: DataFrame, p: Params) -> DataFrame:
    """Pairs whose sizes and second sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if t.num_rows:
                yield t.filter(pa.array(_may_link(*[t.column(c) for c in ("na", "sa", "nb", "sb")], p))).select(["a", "b"])

    of = lambda x: known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a long, b long")


def _by_width(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and their sketches (64-bit words) by width in bits."""
    data, offsets = text_bytes(column)
    size = np.diff(offsets)
    out = {}
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out[int(n) * 8] = rows, data[offsets[rows][:, None] + np.arange(n)].view(np.uint64)
    return out


def _may_link(na, sa, nb, sb, p: Params) -> np.ndarray:
    """Linked sets' sizes are within a quarter, so their widths are equal or neighbours; a wider sketch is folded."""
    na, nb = na.to_numpy(), nb.to_numpy()
    low, high = p.share
    close = high * np.minimum(na, nb) >= low * np.maximum(na, nb)
    out = np.zeros(len(na), bool)
    left, right = _by_width(sa), _by_width(sb)
    for width, (rows, bits) in left.items():
        for other in (width // 2, width, width * 2):
            if other in right:
                both, i, j = np.intersect1d(rows, right[other][0], assume_unique=True, return_indices=True)
                for k in range(0, len(both), max(1, (8 << 20) // width)):
                    part = slice(k, k + max(1, (8 << 20) // width))
                    x, y = bits[i[part]], right[other][1][j[part]]
                    x, y = (folded(x), y) if other < width else (x, folded(y)) if other > width else (x, y)
                    at = both[part]
                    out[at] = close[at] & (np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= hamming_bound(na[at], nb[at], p.share))
    return out


def verify(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """The linked ones of pairs (a, b). texts: (node, text), one row a node of the pairs.

    A star's members are read beside its centre's set, `p.star` of them at a time, so one busy centre is spread.
    """
    members = pairs.groupBy("a").agg(F.count("*").alias("k"))
    ways = F.ceil(F.col("k") / p.star).cast("int")
    centres = members.withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1))).join(texts.hint("merge"), F.col("a") == F.col("node")).select("a", "way", F.lit(None).cast("long").alias("b"), "text")
    others = pairs.join(members, "a").withColumn("way", F.pmod(F.xxhash64("b"), ways).cast("int")).join(texts.hint("merge"), F.col("b") == F.col("node")).select("a", "way", "b", "text")
    low, high = p.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for part in slices(batches, "text"):
            found_a, found_b = [], []
            for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), shingle_sets(part.column("text"), p.span)):
                if b is None:
                    centre, own = a, s
                else:
                    assert centre == a
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if high * both >= low * (len(own) + len(s) - both):
                        found_a.append(a)
                        found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    dealt = centres.unionByName(others).repartition(shuffle_parts(pairs.sparkSession), "a", "way")
    return dealt.sortWithinPartitions("a", "way", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def cross_pairs(members: DataFrame, roots: DataFrame, known: DataFrame, p: Params, forest: bool) -> DataFrame:
    """Pairs of a large group's members that are in different components and near by sketch.

    members: (key, node, n), n nodes in the group. Groups of one component are done with. The others are cut into
    blocks, and each two blocks are compared in a task of their own. With `forest` only pairs that would connect what
    the pairs before them do not are returned, fewer than there are members; else all.
    """
    ways = F.ceil(F.col("n") / p.block).cast("int")
    rooted = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), ways.alias("ways"), F.pmod(F.xxhash64("node"), ways).cast("int").alias("own"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("ways").alias("ways")).where("lo <> hi")
    # joined by block, so that one busy key is not one task's work
    open_blocks = open_keys.select("key", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("own"))
    rows = rooted.join(open_blocks, ["key", "own"]).join(known.select("node", "n_shingles", "sketch"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root", "n_shingles", "sketch")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n, root, node, own = (t.column(c).to_numpy() for c in ("n_shingles", "root", "node", "own"))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        sketch = t.column("sketch").combine_chunks()
        own_width = _by_width(sketch.chunk(0) if isinstance(sketch, pa.ChunkedArray) else sketch)
        low, high = p.share
        # at each width: the sets of that width, and those of twice the width, folded
        at_width = {}
        for width in own_width:
            parts = [own_width[width]] + ([(own_width[2 * width][0], folded(own_width[2 * width][1]))] if 2 * width in own_width else [])
            rows_here, bits_here = np.concatenate([r for r, _ in parts]), np.concatenate([b for _, b in parts])
            mine = own[rows_here] == y
            at_width[width] = rows_here, bits_here, rows_here[mine], bits_here[mine]
        root = root.copy()
        a, b = [], []
        for width, (rows_here, bits_here, right, right_bits) in at_width.items():
            narrow = len(own_width[width][0])  # these come first; two folded sets meet at their own width
            right_narrow = np.isin(right, own_width[width][0])
            for k in np.flatnonzero(own[rows_here] == x):
                i = rows_here[k]
                can = (root[i] != root[right]) & (high * np.minimum(n[i], n[right]) >= low * np.maximum(n[i], n[right]))
                if k >= narrow:
                    can &= right_narrow
                other = np.flatnonzero(can)
                if not len(other):
                    continue
                far = np.bitwise_count(bits_here[k] ^ right_bits[other]).sum(1, dtype=np.int64)
                hit = right[other[far <= hamming_bound(n[i], n[right[other]], p.share)]]
                if forest and len(hit):
                    joined, first = np.unique(root[hit], return_index=True)
                    hit = hit[first]
                    root[np.isin(root, joined)] = root[i]
                a.append(np.minimum(node[i], node[hit]))
                b.append(np.maximum(node[i], node[hit]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1) if a else np.zeros((2, 0), np.int64)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    # few bytes, much work: as many tasks as there are, not as many as the bytes ask for
    rows = rows.repartition(shuffle_parts(members.sparkSession, 2), "key", "x", "y")
    return rows.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def join(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots): every row's id, n_shingles and node; verified links between nodes, enough to
    connect all that links connect; and (node, root) of the nodes that are linked."""
    rows = materialize(nodes(df, p, id_col, text_col), "ngram-nodes")
    known = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "n_shingles", "sketch")).alias("x")).select("node", F.col("x.id").alias("id"), "x.n_shingles", "x.sketch")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    met = materialize(meetings(df, p, text_col, total), "ngram-met")
    members = met.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "n")
    tested = materialize(_near(met.where("key IS NULL").select("a", "b").distinct(), known, p), "ngram-pairs")
    texts = materialize(_texts(df, tested, members, known, p, id_col, text_col), "ngram-texts")
    links = materialize(verify(tested, texts, p), "ngram-links")
    least = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi")
    same_id = least.join(rows, "id").select("a", F.col("node").alias("b")).where("a <> b")  # rows of one id are one node
    roots = materialize(components(links.unionByName(same_id)), "ngram-roots")
    # first the pairs that would connect most, then whatever is still apart
    few = members.withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy("key"))).where(F.col("_k") <= p.forest_keys).drop("_k")
    for forest in (True, False):
        more = cross_pairs(few if forest else members, roots, known, p, forest)
        more = materialize(more.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        if not more.isEmpty():
            tested = tested.unionByName(more)
            links = links.unionByName(materialize(verify(more, texts, p), "ngram-links"))
            roots = materialize(components(links.unionByName(same_id)), "ngram-roots")
    return rows, links, roots


def _texts(df: DataFrame, pairs: DataFrame, members: DataFrame, known: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of every node that may be verified: one id's rows for each node."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    ids = asked.join(known.select("node", "id"), "node")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are merged at every size: a broadcast of ids would change to this plan as they grow
    texts = ids.join(docs.hint("merge"), ids["id"].eqNullSafe(docs["id"])).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of ids that repeat with other texts, only the texts that have the node's set."""
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), p.span)
            yield part.filter(pa.array([len(s) > 0 and node_of(s) == n for s, n in zip(sets, part.column("node").to_pylist())], pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def group_ids(rows: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_shingles, component_id. Rows of one id are one node of the graph."""
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id")).where("root IS NOT NULL")
    return rooted.join(least, "root", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without all but the first document (by id) of each component; rows without id stay."""
    rows, _, roots = join(df, p, id_col, text_col)
    gone = group_ids(rows, roots, "id").where("id <> component_id").select(F.col("id").alias(free_name(df, "_id"))).distinct()
    return df.join(gone, F.col(id_col) == gone[gone.columns[0]], "left_anti")
