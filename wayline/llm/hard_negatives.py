"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors of whole numbers are ordered along a Hilbert curve through their most spread components and cut into Parquet rows
of `block` vectors, each with a zone map: the least and greatest value of every component, and of the labels. For an
anchor and a block, interval arithmetic on the zone map bounds every inner product in the block from both sides. A
query (an anchor's positives, or the window of scores that one of its positives allows) reads only the blocks whose bounds
meet its range of scores, and whose labels can be asked for.

Every query first reads its anchor's own block, which lies among its neighbours on the curve; the k-th score found there
raises the range's lower end before other blocks are chosen. Anchors are held in chunks; a task takes one chunk and some
of the blocks that it asked for, those with the highest bounds first, and skips what the scores found so far rule out. So
no task holds more than a chunk, its best rows and one block, and a label, a cell or a repeated vector that many rows have
only makes more blocks.

Defined results: rows with a null id, label or vector, or with a null, NaN or infinite component, take no part; a shorter
vector has zeros in the components it lacks; a row is not its own positive, but rows that repeat its id are; repeated rows
count as often as they are there; an anchor without positives, or a positive whose window is empty, has no row; an empty
table gives an empty result. Labels are whole numbers. Components beyond 2^27 in magnitude raise, as products would not
fit a long. Only the three columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_parts

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Params:
    every: int = 100  # anchors are the rows whose id this divides
    positives: int = 5
    negatives: int = 10
    low: int = 30  # per cent of the positive's score, from
    high: int = 90  # to
    scale: int = 256
    block: int = 256  # vectors of a block
    chunk: int = 128  # anchors of a chunk
    zones: int = 1024  # zone maps that are weighed at once
    reach: int = 64  # blocks that a task reads for one chunk
    curve_dims: int = 8
    curve_bits: int = 7


def relabelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Wrong labels as the report asks for them: where 7 divides the id, the next of ten labels."""
    return df.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col)))


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of whole numbers of `bits` bits (bits * columns <= 63)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of every level below
        for d in range(n):
            turned = (x[d] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[d] ^= swap
        q >>= 1
    for d in range(1, n):  # Gray code
        x[d] ^= x[d - 1]
    parity, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        parity ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= parity
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; by floating point where every partial sum is a whole number below 2^53."""
    most = (int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) + 1) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what the inner products of each row of a with a vector within each box lie."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def _spread(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Components, the greatest magnitude, and (component, least, greatest) by falling variance. A row a component."""
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("s")).collect()
    if not each:
        return 0, 0, np.zeros((0, 3), np.int64)
    order = sorted(each, key=lambda r: (-r["s"], r["d"]))
    return max(r["d"] for r in each) + 1, max(max(-r["lo"], r["hi"]) for r in each), np.array([(r["d"], r["lo"], r["hi"]) for r in order], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of `dims` components; what is lacking is zero."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == dims * len(column):
        return flat.reshape(-1, dims).astype(np.int32)
    out = np.zeros((len(column), dims), np.int32)
    for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
        out[k, : j - i] = flat[i:j]
    return out


_BLOCKS = "block bigint, lo binary, hi binary, label_lo bigint, label_hi bigint, ids array<bigint>, labels array<bigint>, vectors binary"


def blocks(rows: DataFrame, dims: int, spread: np.ndarray, p: Params) -> DataFrame:
    """The vectors along the curve in blocks, each with its zone map. rows: (id, label, v)."""
    axes = spread[: p.curve_dims]
    step = np.maximum(1, -(-(axes[:, 2] - axes[:, 1] + 1) >> p.curve_bits)) if len(axes) else np.ones(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dims)
                at = hilbert((x[:, axes[:, 0]] - axes[:, 1]).clip(0) // step, p.curve_bits) if dims else np.zeros(b.num_rows, np.int64)
                vectors = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(at), vectors], names=["id", "label", "place", "vector"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, number = TaskContext.get().partitionId() << 32, [], 0

        def rows_of(part: pa.Table) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.int32).reshape(-1, dims)
            ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
            one = lambda a: _lists(a, np.array([len(a)]))
            of = [[at + number], [x.min(0).tobytes()], [x.max(0).tobytes()], [labels.min()], [labels.max()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(of, kinds)] + [one(ids), one(labels), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "lo", "hi", "label_lo", "label_hi", "ids", "labels", "vectors"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= p.block:
                table = pa.Table.from_batches(held)
                while table.num_rows >= p.block:
                    yield rows_of(table.slice(0, p.block))
                    number, table = number + 1, table.slice(p.block)
                held = table.to_batches()
        if sum(x.num_rows for x in held):
            yield rows_of(pa.Table.from_batches(held))

    placed = rows.mapInArrow(place, "id bigint, label bigint, place bigint, vector binary")
    dealt = placed.repartitionByRange(shuffle_parts(rows.sparkSession), "place", "id").sortWithinPartitions("place", "id")
    return materialize(dealt.mapInArrow(cut, _BLOCKS), "hilbert-blocks")


_CHUNKS = "chunk bigint, ids array<bigint>, labels array<bigint>, home array<bigint>, spot array<bigint>, vectors binary, anchor array<bigint>, q_lo array<bigint>, q_hi array<bigint>, q_id array<bigint>, q_score array<bigint>"


def chunks(of: DataFrame, dims: int, p: Params) -> DataFrame:
    """The anchors, some blocks' together, each with one query for its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, number = TaskContext.get().partitionId() << 32, [], 0

        def row(part: list) -> pa.RecordBatch:
            n = len(part)
            ids, labels, home, spot = (np.array([x[k] for x in part], np.int64) for k in range(4))
            vectors = b"".join(x[4] for x in part)
            queries = [np.arange(n), np.full(n, LOW), np.full(n, HIGH), np.zeros(n, np.int64), np.zeros(n, np.int64)]
            cols = [pa.array([at + number])] + [_lists(x, np.array([n])) for x in (ids, labels, home, spot)] + [pa.array([vectors], pa.binary())] + [_lists(x, np.array([n])) for x in queries]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _CHUNKS.split(", ")])

        for b in batches:
            for r in range(b.num_rows):
                ids = b.column("ids")[r].values.to_numpy()
                hits = np.flatnonzero(ids % p.every == 0)
                if len(hits):
                    x = np.frombuffer(b.column("vectors")[r].as_py(), np.int32).reshape(-1, dims)
                    labels, block = b.column("labels")[r].values.to_numpy(), b.column("block")[r].as_py()
                    held += [(ids[k], labels[k], block, k, x[k].tobytes()) for k in hits]
                while len(held) >= p.chunk:
                    yield row(held[: p.chunk])
                    held, number = held[p.chunk :], number + 1
        if held:
            yield row(held)

    return materialize(of.select("block", "ids", "labels", "vectors").mapInArrow(run, _CHUNKS), "anchor-chunks")


def zone_packs(of: DataFrame, p: Params) -> tuple[DataFrame, int, int]:
    """Zone maps, `p.zones` a row: (pack, zones), their number and the blocks' number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, p.zones):
                part = b.slice(k, p.zones)
                n = np.array([part.num_rows])
                cols = [_lists(part.column(c).to_numpy(), n) for c in ("block", "label_lo", "label_hi")] + [pa.array([b"".join(part.column(c).to_pylist())], pa.binary()) for c in ("lo", "hi")]
                yield pa.RecordBatch.from_arrays(cols, names=["blocks", "label_lo", "label_hi", "lo", "hi"])

    packs = of.select("block", "lo", "hi", "label_lo", "label_hi").mapInArrow(run, "blocks array<bigint>, label_lo array<bigint>, label_hi array<bigint>, lo binary, hi binary")
    packs = materialize(packs.withColumn("first", F.element_at("blocks", 1)), "zone-packs")
    # a number from 0 on without one task for all: packs before this one in its partition, and partitions before
    n, blocks_n = packs.agg(F.count("*"), F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()
    return packs.withColumn("pack", F.pmod(F.xxhash64("first"), F.lit(max(n, 1)))).drop("first"), n, blocks_n


def plan(of: DataFrame, packs: DataFrame, n_packs: int, dims: int, same: bool) -> DataFrame:
    """(chunk, block, need, top): which blocks each chunk must read, for which queries (a bit each), and the greatest bound.

    Every chunk weighs every pack of zone maps; own blocks have been read before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                of_list = lambda c: row[c].values.to_numpy(zero_copy_only=False)
                a = np.frombuffer(row["vectors"].as_py(), np.int32).reshape(-1, dims)
                zone = [np.frombuffer(row[c].as_py(), np.int32).reshape(-1, dims) for c in ("lo", "hi")]
                least, most = bounds(a, *zone)
                labels, l_lo, l_hi, q = of_list("labels")[:, None], of_list("label_lo")[None, :], of_list("label_hi")[None, :], of_list("anchor")
                can = (l_lo <= labels) & (labels <= l_hi) if same else ~((l_lo == labels) & (labels == l_hi))
                can &= of_list("home")[:, None] != of_list("blocks")[None, :]
                need = can[q] & (most[q] >= of_list("q_lo")[:, None]) & (least[q] <= of_list("q_hi")[:, None])
                hit = np.flatnonzero(need.any(0))
                bits = np.packbits(need[:, hit], axis=0).T
                top = np.where(need[:, hit], most[q][:, hit], LOW).max(0, initial=LOW)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), row["chunk"].as_py(), np.int64)), pa.array(of_list("blocks")[hit]), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(top)], names=["chunk", "block", "need", "top"])

    each = of.select("chunk", "labels", "home", "vectors", "anchor", "q_lo", "q_hi").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(max(n_packs, 1) - 1)).cast("array<bigint>")))
    return each.join(packs, "pack").mapInArrow(run, "chunk bigint, block bigint, need binary, top bigint")


def homes(of: DataFrame) -> DataFrame:
    """The own blocks of a chunk's anchors, as plan() gives them; all queries of other anchors look on."""
    return of.select("chunk", F.explode(F.array_distinct("home")).alias("block")).select("chunk", "block", F.lit(None).cast("binary").alias("need"), F.lit(HIGH).alias("top"))


def visit(of: DataFrame, pairs: DataFrame, store: DataFrame, dims: int, ways: int, k: int, same: bool) -> DataFrame:
    """(chunk, q, score, id): for every query the k best rows of the blocks that its chunk reads, per task."""
    parts = shuffle_parts(of.sparkSession, 2)
    payload = [c for c in of.columns if c not in ("chunk", "q_id", "q_score")]
    centres = of.drop("q_id", "q_score").withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    read = pairs.withColumn("way", F.pmod(F.xxhash64("block"), F.lit(ways)).cast("int")).join(store.select("block", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors")), "block")
    dealt = centres.unionByName(read, allowMissingColumns=True).repartition(parts, "chunk", "way")
    dealt = dealt.sortWithinPartitions("chunk", "way", F.col("block").isNotNull(), F.col("top").desc(), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, found = None, []

        def best() -> list[np.ndarray]:
            q, s, i = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((i, -s, q))
            q, s, i = q[order], s[order], i[order]
            first = np.concatenate([[True], q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
            last = rank == k - 1
            lo[q[last]] = np.maximum(lo[q[last]], s[last])  # rows of equal score may still have a smaller id
            return [x[rank < k] for x in (q, s, i)]

        def result() -> pa.RecordBatch:
            q, s, i = best() if found else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), chunk, np.int64)), pa.array(q.astype(np.int32)), pa.array(s), pa.array(i)], names=["chunk", "q", "score", "id"])

        for b in batches:
            for r in range(b.num_rows):
                of_list = lambda c: b.column(c)[r].values.to_numpy(zero_copy_only=False)
                if not b.column("block")[r].is_valid:
                    if found:
                        yield result()
                    chunk, found = b.column("chunk")[r].as_py(), []
                    a = np.frombuffer(b.column("vectors")[r].as_py(), np.int32).reshape(-1, dims)
                    anchor, lo, hi, labels, home, spot = of_list("anchor"), of_list("q_lo").copy(), of_list("q_hi"), of_list("labels"), of_list("home"), of_list("spot")
                    continue
                need = b.column("need")[r].as_py()
                block, ids = b.column("block")[r].as_py(), of_list("b_ids")
                asked = np.flatnonzero(home[anchor] == block) if need is None else np.flatnonzero(np.unpackbits(np.frombuffer(need, np.uint8), count=len(anchor)))
                asked = asked[lo[asked] <= b.column("top")[r].as_py()]
                if not len(asked):
                    continue
                who, row = np.unique(anchor[asked], return_inverse=True)
                score = products(a[who], np.frombuffer(b.column("b_vectors")[r].as_py(), np.int32).reshape(-1, dims))
                can = labels[who][:, None] == of_list("b_labels")[None, :] if same else labels[who][:, None] != of_list("b_labels")[None, :]
                at_home = np.flatnonzero(home[who] == block)
                can[at_home, spot[who[at_home]]] = False
                hit, col = np.nonzero(can[row] & (score[row] >= lo[asked][:, None]) & (score[row] <= hi[asked][:, None]))
                if len(hit):
                    found.append([asked[hit].astype(np.int64), score[row[hit], col], ids[col]])
                    found = [best()]
        if found:
            yield result()

    return materialize(dealt.mapInArrow(run, "chunk bigint, q int, score bigint, id bigint"), "visited")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("chunk", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def raised(of: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The chunks' queries with the k-th score found so far as the least that matters."""
    kth = best_of(found, k).where(F.col("rank") == k).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("q", "score"))).alias("kth"))  # an entry a query of the chunk
    known = of.join(kth, "chunk", "left")
    at = F.transform("q_lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
    return materialize(known.withColumn("q_lo", F.when(F.col("kth").isNull(), F.col("q_lo")).otherwise(at)).drop("kth"), "anchor-chunks")


def windows(of: DataFrame, positives: DataFrame, p: Params) -> DataFrame:
    """The chunks with one query for each positive: scores from ceil(low %) to floor(high %) of the positive's."""
    by = positives.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("q", "rank", "id", "score"))).alias("found"))  # positives times anchors of a chunk
    asked = of.drop("anchor", "q_lo", "q_hi", "q_id", "q_score").join(by, "chunk")
    each = lambda f: F.transform("found", f)
    return materialize(
        asked.withColumn("anchor", each(lambda x: x["q"].cast("bigint")))
        .withColumn("q_lo", F.expr(f"transform(found, x -> -((-x.score * {p.low} - pmod(-x.score * {p.low}, 100)) div 100))"))
        .withColumn("q_hi", F.expr(f"transform(found, x -> (x.score * {p.high} - pmod(x.score * {p.high}, 100)) div 100)"))
        .withColumn("q_id", each(lambda x: x["id"]))
        .withColumn("q_score", each(lambda x: x["score"]))
        .drop("found"),
        "anchor-chunks",
    )


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, p: Params = Params(), id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    sound = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & sound)
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(float(p.scale)) * x.cast("double")))
    rows = kept.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v"))
    dims, magnitude, spread = _spread(rows)
    if magnitude >= 1 << 31 or dims * magnitude**2 * 100 >= 1 << 63:
        raise OverflowError(f"components up to {magnitude}: inner products would not fit a long")
    if not dims:
        return df.sparkSession.createDataFrame([], _RESULT)
    store = blocks(rows, dims, spread, p)
    packs, n_packs, n_blocks = zone_packs(store, p)
    ways = max(1, -(-n_blocks // p.reach))
    asked = chunks(store, dims, p)

    def search(of: DataFrame, k: int, same: bool) -> DataFrame:
        own = visit(of, homes(of), store, dims, 1, k, same)
        of = raised(of, own, k)
        return best_of(own.unionByName(visit(of, plan(of, packs, n_packs, dims, same), store, dims, ways, k, same)), k)

    asked = windows(asked, search(asked, p.positives, same=True), p)
    negatives = search(asked, p.negatives, same=False)
    named = asked.select("chunk", F.posexplode(F.arrays_zip(F.transform("anchor", lambda a: F.element_at("ids", (a + 1).cast("int"))).alias("anchor_id"), F.col("q_id").alias("positive_id"), F.col("q_score").alias("positive_score"))).alias("q", "of"))
    return negatives.join(named, ["chunk", "q"]).select("of.anchor_id", "of.positive_id", "rank", F.col("id").alias("negative_id"), "of.positive_score", F.col("score").alias("negative_score"))
