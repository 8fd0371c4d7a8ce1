"""Ordinal cumulative-link regression on graded ratings.

Texts become hashed features (words, their beginnings, word shapes, length and variety classes); one weight
vector is shared by all grades, ordered thresholds separate them: P(grade > k) = sigmoid(score - threshold_k).
The fitted model gives every document its expected grade and the probability of a grade in the upper tail.

The model is fitted on a bounded sample of rated rows (`Params.sample`, those with the smallest hash of their
id); every document is scored, over its whole text, in one pass without a shuffle.

Defined results: a null or empty text has only the length features; rows without a rating are not fitted on;
with no rated row at all the score is 0 for all; repeated rows are scored each by themselves; only the id, text
and grade columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, hash_words, mix64, slices, words_of


@dataclass(frozen=True)
class Params:
    bits: int = 17  # 2^bits weights: the bound of what tasks receive
    sample: int = 6000  # rated rows to fit on, at most
    grades: int = 3
    rounds: int = 120
    rate: float = 0.15
    ridge: float = 1e-4
    doubt: float = 2.0  # standard errors by which a feature's log ratio is shrunk
    least_rows: int = 4  # rarer features are not fitted
    tail: int = 2  # kept documents reach this grade
    threshold: float = 0.5


CACHE_BYTES = 48 << 20  # of remembered words and their features, in a worker
_cache: dict = {"bits": None, "of": {}, "table": np.zeros((0, 5), np.int32), "bytes": 0}


def _word_features(kinds: pa.Array, bits: int) -> np.ndarray:
    """Per distinct word five hashed features: itself, its beginnings of 4, 5 and 6 letters, its shape."""
    mask = np.uint64((1 << bits) - 1)
    bare = pc.utf8_lower(pc.replace_substring_regex(kinds, r"[^\p{L}]+", ""))
    shape = kinds
    for pattern, into in ((r"\p{Lu}+", "A"), (r"[\p{Ll}]+", "a"), (r"[0-9]+", "9"), (r"([^Aa9])[^Aa9]+", r"\1\1")):
        shape = pc.replace_substring_regex(shape, pattern, into)
    parts = [(1, bare), *((k, pc.utf8_slice_codeunits(bare, 0, k)) for k in (4, 5, 6)), (99, pc.utf8_slice_codeunits(shape, 0, 8))]
    return np.stack([(mix64(hash_words(x) + np.uint64(salt)) & mask).astype(np.int32) for salt, x in parts], axis=1)


def _features_of(kinds: pa.Array, bits: int) -> np.ndarray:
    """As _word_features, each word once a worker while it is remembered. The cache is emptied when it is full, so
    its size is bounded and what it holds does not change a result."""
    if _cache["bits"] != bits or _cache["bytes"] > CACHE_BYTES:
        _cache.update(bits=bits, of={}, table=np.zeros((0, 5), np.int32), bytes=0)
    known, words = _cache["of"], kinds.to_pylist()
    at = [known.get(w, -1) for w in words]
    new = np.flatnonzero(np.array(at, np.int64) < 0)
    if len(new):
        found = _word_features(kinds.take(pa.array(new)), bits)
        first = len(_cache["table"])
        _cache["table"] = np.concatenate([_cache["table"], found])
        for i, k in enumerate(new.tolist()):
            at[k] = known[words[k]] = first + i
            _cache["bytes"] += 200 + 4 * len(words[k])
    return _cache["table"][np.array(at, np.int64)] if words else np.zeros((0, 5), np.int32)


def features(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed features of a column of texts; each feature once a row."""
    n, mask = len(text), np.uint64((1 << bits) - 1)
    words, rows = words_of(text)
    coded = words.dictionary_encode()
    kinds, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(rows, minlength=n)
    pairs = distinct(rows * (1 << 32) + codes)
    of, kind = pairs >> 32, pairs & 0xFFFFFFFF
    variety = np.bincount(of, minlength=n) * 16 // np.maximum(n_words, 1)
    dense = [np.log2(n_words + 1).astype(np.int64) + 1000, variety + 2000]
    per_word = _features_of(kinds, bits)[kind].astype(np.int64)
    own = np.repeat(of, 5) * (1 << bits) + per_word.ravel()
    extra = [np.arange(n) * (1 << bits) + (mix64(d.astype(np.uint64)) & mask).astype(np.int64) for d in dense]
    pairs = distinct(np.concatenate([own, *extra]))
    return pairs >> bits, pairs & int(mask)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, grades - 1 of them
    bits: int

    def score(self, text: pa.Array) -> np.ndarray:
        rows, feats = features(text, self.bits)
        return np.bincount(rows, self.weights[feats], minlength=len(text))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))


def _evidence(rows: np.ndarray, feats: np.ndarray, grade: np.ndarray, p: Params) -> np.ndarray:
    """Per feature the largest absolute log ratio of its rates above and below any threshold; 0 if it is rare."""
    size = 1 << p.bits
    by_grade = np.stack([np.bincount(feats[grade[rows] == g], minlength=size) for g in range(p.grades)]).astype(float)
    rated = np.bincount(grade, minlength=p.grades).astype(float)
    out = np.zeros(size)
    for k in range(1, p.grades):
        low, high = by_grade[:k].sum(0), by_grade[k:].sum(0)
        ratio = np.log((low + 0.5) / (rated[:k].sum() + 1)) - np.log((high + 0.5) / (rated[k:].sum() + 1))
        spread = np.sqrt(1 / (low + 0.5) + 1 / (high + 0.5))
        out = np.maximum(out, np.maximum(0, np.abs(ratio) - p.doubt * spread))
    return np.where(by_grade.sum(0) >= p.least_rows, out, 0)


def fit_arrays(rows: np.ndarray, feats: np.ndarray, grade: np.ndarray, p: Params) -> Model:
    """Full-batch adaptive gradient steps on the mean cumulative log loss; features are scaled by their evidence."""
    n, size, k = len(grade), 1 << p.bits, p.grades - 1
    w = np.zeros(size)
    cut = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
    if not n:
        return Model(w, cut, p.bits)
    scale = _evidence(rows, feats, grade, p)
    used = scale[feats] > 0
    rows, feats = rows[used], feats[used]
    share = np.bincount(grade, minlength=p.grades)
    weight = 1 / np.sqrt(np.maximum(share, 1))[grade]
    weight /= weight.sum()
    target = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    seen_w, seen_c = np.full(size, 1e-12), np.full(k, 1e-12)
    for _ in range(p.rounds):
        score = np.bincount(rows, (w * scale)[feats], minlength=n)
        chance = 1 / (1 + np.exp(-np.clip(score[:, None] - cut[None, :], -40, 40)))
        gap = (chance - target) * weight[:, None]
        g = np.bincount(feats, gap.sum(1)[rows], minlength=size) * scale + p.ridge * w
        c = -gap.sum(0)
        seen_w += g * g
        seen_c += c * c
        w -= p.rate * g / np.sqrt(seen_w)
        cut = np.maximum.accumulate(cut - p.rate * c / np.sqrt(seen_c))
    return Model(w * scale, cut, p.bits)


def fit(rated: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on `rated`, rows with a text and a grade of 0 .. grades - 1 (others are left out)."""
    sample = rated.where(F.col(grade_col).between(0, p.grades - 1)).orderBy(F.xxhash64(id_col), id_col).limit(p.sample)
    grade_rows = sample.select(F.col(text_col).alias("text"), F.col(grade_col).cast("int").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, feats = features(part.column("text"), p.bits)
            at = np.searchsorted(rows, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feats, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, part.column("grade")], names=["feats", "grade"])

    got = grade_rows.mapInArrow(run, "feats array<int>, grade int").toArrow()  # p.sample rows of features at most
    lists = got["feats"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    feats = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return fit_arrays(rows, feats, got["grade"].to_numpy().astype(np.int64), p)


def sample_rated(documents: DataFrame, ratings: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of a bounded sample of rated ids: the sample (p.sample ids) is broadcast, texts are not shuffled. Only the id
    and text columns of documents are read."""
    some = ratings.where(F.col("grade").isNotNull()).select(id_col, "grade").orderBy(F.xxhash64(id_col), id_col).limit(p.sample)
    return documents.select(id_col, text_col).join(F.broadcast(some), id_col)


def score(df: DataFrame, model: Model, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, expected_grade, tail_prob (of the grade p.tail or more) and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            s = model.score(part.column("text"))
            above = model.above(s)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(s), pa.array(above.sum(1)), pa.array(above[:, p.tail - 1])], names=["id", "score", "expected_grade", "tail_prob"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, expected_grade double, tail_prob double")
    return out.select(F.col("id").alias(id_col), "score", "expected_grade", "tail_prob", (F.col("tail_prob") >= p.threshold).alias("kept"))
