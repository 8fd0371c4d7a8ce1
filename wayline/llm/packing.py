"""Packing token sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and one rest. The rests' length histogram (classes of `grain`
tokens, so its size depends on the sequence length alone) is the demand of a cutting-stock problem: a linear
program over patterns of rests that fit one sequence, whose columns are priced by an unbounded knapsack.
Patterns are rounded down, what is left over is packed first-fit by histogram, and the documents, ranked within
their class, take the patterns' places by arithmetic on their rank.

Only the histogram (at most max_len / grain rows) reaches the driver. Ranks come from per-block counts, so that
one very common length is not one task's work. Defined results: a null or empty text is its closing id alone;
repeated rows are packed each by themselves (rows that share an id are told apart by nothing in the output);
only the id and text columns are read, and ids keep their type; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

CLOSING_ID = 1
CACHE_WORDS = 500_000
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _refuse_others(tokenizer, path)
        _state.update(path=path, tokenizer=tokenizer, cache={})
    return _state["tokenizer"], _state["cache"]


def _refuse_others(tokenizer, path: str) -> None:
    """Raise if a vocabulary does not do what tokenize() relies on: 16-bit ids, nothing joined across blanks and line
    ends, no case, a comma or full stop after a word apart from it."""
    ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    words = ["Hello", "WORLD", "Straße", "ÉTÉ", "x9_", "don't"]
    parts = [i for w in words for i in ids(w.lower() if w[0].isalpha() and w.isalpha() else w)]
    apart = all(ids(w.lower() + c) == ids(w.lower()) + ids(c) for w in words[:4] for c in ".,")
    if tokenizer.get_vocab_size() > 1 << 16 or not apart or any(ids(j.join(words)) != parts for j in (" ", "\n", "  ")):
        raise ValueError(f"{path}: packing needs a vocabulary of at most 65,536 ids that ignores case and joins nothing across blanks")


def tokenize(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts, one after the other, and n + 1 offsets.

    The vocabulary drops white space and joins nothing across it, so texts are cut at blanks and line ends and
    each distinct piece is encoded once and remembered. ASCII and Latin-1 words share one entry for all cases,
    with and without a comma or full stop after them: a piece is a stem and an ending.
    """
    tokenizer, cache = _tokenizer(path)
    n = len(text)
    lists = pc.split_pattern(pc.replace_substring(pc.fill_null(text, ""), "\n", " "), " ")
    pieces, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pieces.dictionary_encode()
    codes, kinds = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    # case does not matter, and for these letters it is a plain matter of one to one
    plain = pc.match_substring_regex(kinds, r"^[A-Za-zÀ-ÖØ-Þß-öø-ÿ]+[.,]?$")
    stop = pc.and_(plain, pc.ends_with(kinds, ".")).to_numpy(zero_copy_only=False)
    comma = pc.and_(plain, pc.ends_with(kinds, ",")).to_numpy(zero_copy_only=False)
    stems = pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(kinds, ".,")), kinds).dictionary_encode()
    keys = stems.dictionary.to_pylist()
    missing = [k for k in keys if k not in cache]
    if len(cache) + len(missing) > CACHE_WORDS:
        cache.clear()
        missing = keys
    for a in range(0, len(missing), 4096):
        part = missing[a : a + 4096]
        cache.update(zip(part, [struct.pack(f"<{len(e)}H", *e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]))
    endings = [b"", *(struct.pack(f"<{len(i)}H", *i) for i in (tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"))]
    found = [cache[k] for k in keys] + endings
    flat = np.frombuffer(b"".join(found), np.uint16)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 2
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    # two segments a piece: its stem's and its ending's ids
    segment = np.stack([stems.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(keys) + stop + 2 * comma], axis=1)[codes].ravel()
    each = size[segment]
    done = np.cumsum(each)
    at = np.repeat(begin[segment] - done + each, each) + np.arange(each.sum())
    total = np.bincount(np.repeat(rows, 2), each, minlength=n).astype(np.int64)
    return flat[at], np.concatenate([[0], np.cumsum(total)])


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces: full sequences, then the rest, of every document's ids with the closing id."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 10 << 20):
            ids, offsets = tokenize(part.column("text"), path)
            out: list[tuple] = []
            closing = np.array([CLOSING_ID], np.uint32)
            for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                own = np.concatenate([ids[a:b].astype("<u4"), closing])
                out += [(row, s, len(x := own[s : s + max_len]), zlib.crc32(x.tobytes()), len(own)) for s in range(0, len(own), max_len)]
            of, *rest = (pa.array(c, pa.int64()) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([part.column("id").take(of), *rest], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def _knapsack(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best multiset of classes 1..len(value) (class c takes c units) within `room` units."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    sizes = np.arange(1, len(value) + 1)
    for r in range(1, room + 1):
        k = min(r, len(value))
        with_item = best[r - sizes[:k]] + value[:k]
        i = int(np.argmax(with_item))
        if with_item[i] > best[r - 1] + 1e-12:
            best[r], last[r] = with_item[i], i + 1
        else:
            best[r] = best[r - 1]
    used, r = np.zeros(len(value), np.int64), room
    while r > 0:
        if last[r]:
            used[last[r] - 1] += 1
            r -= last[r]
        else:
            r -= 1
    return best[room], used


def greedy(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, filled with the largest classes first until the demand is met."""
    left, out = demand.copy(), []
    while left.any():
        pattern, space = np.zeros(len(demand), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            k = min(int(left[c]), space // (int(c) + 1))
            pattern[c], space = k, space - k * (int(c) + 1)
            if not space:
                break
        used = np.flatnonzero(pattern)
        times = int((left[used] // pattern[used]).min())
        left[used] -= times * pattern[used]
        out.append((pattern, times))
    return out


def column_generation(demand: np.ndarray, room: int, gap: float = 1e-4, afresh: int = 256) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (classes x patterns) and their amounts of the linear program min sum x, patterns x = demand, and a proven
    lower bound of its value.

    Revised simplex on the classes with demand. It starts from one-class patterns; the greedy patterns are priced
    first, then the knapsack's answers to the duals; the ratio test names the pattern that leaves. Duals divided by the
    best pattern's price are feasible, so they bound the value from below: pricing ends when the value is within one
    sequence, or within `gap` of itself, of the best such bound, however many columns that takes. The amounts to meet
    are shifted by less than a thousandth of a document, each by another share, so that no step is of no length and no
    basis comes again. The inverse is worked out anew after every `afresh` columns.
    """
    live = np.flatnonzero(demand)
    m = len(live)
    wanted = demand[live] + 1e-3 * np.modf((live + 1) * 0.6180339887498949)[0]
    basis = np.zeros((len(demand), m), np.int64)
    basis[live, np.arange(m)] = room // (live + 1)
    inverse = np.diag(1 / basis[live, np.arange(m)].astype(float))
    amount = inverse @ wanted
    pool = np.stack([p for p, _ in greedy(demand, room)], axis=1)
    bound, columns = 0.0, 0
    while True:
        dual = np.zeros(len(demand))
        dual[live] = np.ones(m) @ inverse
        gains = dual @ pool
        best = int(np.argmax(gains))
        if gains[best] > 1 + 1e-9:
            pattern = pool[:, best]
        else:
            priced = np.maximum(dual, 0)
            gain, pattern = _knapsack(priced, room)
            bound = max(bound, float(priced @ demand) / max(gain, 1.0))
            if gain <= 1 + 1e-9 or amount.sum() - bound < max(1.0, gap * bound):
                return basis, amount, bound
        way = inverse @ pattern[live]
        steps = np.where(way > 1e-9, amount / np.where(way > 1e-9, way, 1), np.inf)
        out = int(np.argmin(steps))
        basis[:, out] = pattern
        columns += 1
        if columns % afresh == 0:
            inverse = np.linalg.inv(basis[live].astype(float))
            amount = np.maximum(inverse @ wanted, 0)
            continue
        step = steps[out]
        amount = np.maximum(amount - step * way, 0)
        amount[out] = step
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot


@dataclass
class Plan:
    """Rows (class, first rank, rank after the last, places per sequence, first sequence), all bounded."""

    cls: np.ndarray
    first: np.ndarray
    after: np.ndarray
    places: np.ndarray
    sequence: np.ndarray
    sequences: int
    bound: float  # no plan has fewer sequences


def plan(demand: np.ndarray, room: int) -> Plan:
    """Whole patterns that meet the demand per class (class c takes c + 1 units of `room`)."""
    demand = np.asarray(demand, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    taken, base, bound = np.zeros(len(demand), np.int64), 0, 0.0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal base
        for c in np.flatnonzero(pattern):
            rows.append((c, taken[c], taken[c] + times * pattern[c], pattern[c], base))
            taken[c] += times * pattern[c]
        base += times

    if demand.sum():
        patterns, amount, bound = column_generation(demand, room)
        full = (patterns * np.arange(1, len(demand) + 1)[:, None]).sum(0) * 64 >= room * 63  # wasteful ones wait for the rest
        for pattern, x in zip(patterns.T[full], np.floor(amount[full] + 1e-9).astype(np.int64)):
            used = np.flatnonzero(pattern)
            x = min(int(x), int(((demand[used] - taken[used]) // pattern[used]).min()))
            if x > 0:
                use(pattern, x)
    for pattern, times in greedy(demand - taken, room):  # what rounding left over
        use(pattern, times)
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, base, bound)


def assign(pieces: DataFrame, max_len: int = 2048, grain: int = 4, blocks: int = 1024) -> DataFrame:
    """Pieces with sequence_id and offset. `pieces` must give the same rows each time it is read (a table)."""
    spark = pieces.sparkSession
    if max_len % grain:
        raise ValueError("grain must divide max_len")
    cls = F.ceil(F.col("length") / grain).cast("int") - 1
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int")
    rest = pieces.where(F.col("length") < max_len).withColumns({"_cls": cls, "_block": block})
    counts = rest.groupBy("_cls", "_block").count()
    by_block = counts.withColumn("_before", F.sum("count").over(Window.partitionBy("_cls").orderBy("_block")) - F.col("count"))  # <= blocks rows a class
    classes = max_len // grain
    demand = np.zeros(classes, np.int64)
    for r in counts.groupBy("_cls").agg(F.sum("count").alias("n")).collect():  # <= classes rows
        demand[r["_cls"]] = r["n"]
    p = plan(demand, classes)
    order = np.lexsort((p.first, p.cls))
    table = {k: getattr(p, k)[order] for k in ("cls", "first", "after", "places", "sequence")}

    ranked = rest.withColumn("_in", F.row_number().over(Window.partitionBy("_cls", "_block").orderBy("doc_id", "start", "ids_crc32")) - 1)
    ranked = ranked.join(by_block.drop("count"), ["_cls", "_block"]).withColumn("_rank", F.col("_before") + F.col("_in"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, r = b.column("_cls").to_numpy().astype(np.int64), b.column("_rank").to_numpy()
            far = int(table["after"].max()) + 1
            at = np.searchsorted(table["cls"] * far + table["first"], c * far + r, side="right") - 1
            within = r - table["first"][at]
            seq = table["sequence"][at] + within // table["places"][at]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq)], names=[*names, "sequence_id"])

    placed = ranked.select(*names, "_cls", "_rank").mapInArrow(run, f"doc_id {pieces.schema['doc_id'].dataType.simpleString()}, {_PIECES}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")  # <= max_len pieces
    placed = placed.withColumn("offset", (F.sum("length").over(inside) - F.col("length")).cast("long"))
    # full sequences: numbered after the others by block counts
    full = pieces.where(F.col("length") == max_len).withColumn("_block", block)
    full_counts = full.groupBy("_block").count()
    full_before = full_counts.withColumn("_before", F.sum("count").over(Window.orderBy("_block")) - F.col("count"))  # <= blocks rows
    full = full.withColumn("_in", F.row_number().over(Window.partitionBy("_block").orderBy("doc_id", "start", "ids_crc32")) - 1)
    full = full.join(F.broadcast(full_before.drop("count")), "_block")
    full = full.select(*names, (F.col("_before") + F.col("_in") + p.sequences).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, grain: int = 4, tokenizer: str | None = None) -> DataFrame:
    return assign(materialize(cut(df, id_col, text_col, max_len, tokenizer), "packing-pieces"), max_len, grain)
