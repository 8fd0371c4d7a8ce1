"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule.
Policies are versioned sets of rules: a policy keeps a document if none of its rules' bits is set, so a new
policy, or one with a rule less, is a bitwise test over the ledger and reads no text again.

Defined results: a null or empty text has no words and fails `few_words`; repeated rows are judged each by
themselves; columns of the input pass through unchanged, the ledger is one struct column, so that names
cannot clash (choose another `out` if the input has that very name); an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import distinct, free_name, slices, text_bytes, words_of

# Words that mark abuse, English only (another list can be given). `blocked_words` judges their rate:
# one such word fails a short text and passes a long one. Toxicity beyond such words is the classifier's work.
BLOCKED = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_blocked")


@dataclass(frozen=True)
class Rule:
    """A named bit of the ledger; `fails` takes the struct of measurements and is never null."""

    bit: int
    name: str
    fails: Callable[[Column], Column]


RULES = (
    Rule(0, "few_words", lambda m: m.n_words < 10),
    Rule(1, "repeated_windows", lambda m: m.n_repeat_words * 100 > m.n_words * 20),
    Rule(2, "symbols", lambda m: m.n_symbols * 10 > m.n_words),
    Rule(3, "repeated_lines", lambda m: m.n_dup_lines * 100 > m.n_lines * 30),
    Rule(4, "word_length", lambda m: (m.word_chars < m.n_words * 2) | (m.word_chars > m.n_words * 15)),
    Rule(5, "upper_case", lambda m: m.n_upper_words * 100 > m.n_words * 50),
    Rule(6, "blocked_words", lambda m: m.n_blocked * 200 > m.n_words),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


POLICIES = (
    Policy("base", BASE_RULES),
    Policy("v1", tuple(r.name for r in RULES if r.name != "blocked_words")),
    Policy("v2", tuple(r.name for r in RULES)),
)
CURRENT = POLICIES[-1]


def _repeat_words(words: np.ndarray, rows: np.ndarray, n_rows: int, span: int = 5) -> np.ndarray:
    """Words per row that lie in a window of `span` words found twice or more in that row.

    Windows get exact numbers: a window's number is that of its first part paired with that of its rest.
    """
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    same = rows[:n] == rows[span - 1 :]
    ids, top = words[:n], int(words.max()) + 1
    for k in range(1, span):
        _, ids = np.unique(ids * top + words[k : n + k], return_inverse=True)
    _, ids, counts = np.unique(ids * n_rows + rows[:n], return_inverse=True, return_counts=True)
    # a window that crosses rows may share a number with a proper one, so only proper ones are counted
    proper = np.bincount(ids[same], minlength=len(counts))
    start = np.flatnonzero(same & (proper[ids] >= 2))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + span, -1)
    return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def measures(text: pa.Array, blocked: tuple[str, ...] = BLOCKED) -> dict[str, np.ndarray]:
    """The measurements of a column of whole texts."""
    n = len(text)
    text = pc.fill_null(text, "")
    words, rows = words_of(text)
    coded = words.dictionary_encode()
    kinds, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    per_row = lambda x: np.bincount(rows, weights=x, minlength=n).astype(np.int64)
    of_kind = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    letters = pc.ascii_lower(pc.replace_substring_regex(kinds, "[^A-Za-z]", ""))
    data, offsets = text_bytes(text)
    marks = np.zeros(256, np.int64)
    marks[list(SYMBOLS.encode())] = 1
    marked = np.concatenate([[0], np.cumsum(marks[data])])
    lists = pc.split_pattern(text, "\n")
    lines, line_rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[full]
    n_lines = np.bincount(line_rows[full], minlength=n)
    first_lines = distinct(line_codes * max(n, 1) + line_rows[full]) % max(n, 1)
    return {
        "n_words": np.bincount(rows, minlength=n),
        "word_chars": per_row(of_kind(pc.utf8_length(kinds))),
        "n_symbols": marked[offsets[1:]] - marked[offsets[:-1]],
        "n_lines": n_lines,
        "n_dup_lines": n_lines - np.bincount(first_lines, minlength=n),
        "n_repeat_words": _repeat_words(codes, rows, n),
        "n_upper_words": per_row(of_kind(pc.match_substring_regex(kinds, "^[A-Z][A-Z]"))),
        "n_blocked": per_row(of_kind(pc.is_in(letters, pa.array(list(blocked))))),
    }


def ledger(df: DataFrame, text_col: str = "text", out: str = "ledger", rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """The input with a struct column `out`: every measurement and `failed`, the bits of the rules that failed."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the input has a column {out}: choose another name for the ledger")
    inner = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    schema = T.StructType([*df.schema.fields, T.StructField(out, inner, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = measures(part.column(text_col), blocked)
            struct = pa.StructArray.from_arrays([pa.array(found[m].astype(np.int64)) for m in MEASURES], names=list(MEASURES))
            yield pa.RecordBatch.from_arrays([*part.columns, struct], names=[*part.schema.names, out])

    measured = df.mapInArrow(run, schema)
    return measured.withColumn(out, F.struct(*[F.col(f"{out}.{m}").alias(m) for m in MEASURES], failure_bits(F.col(out), rules).alias("failed")))


def failure_bits(of: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules' bits, or-ed. `of`: the struct of measurements."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(of), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def kept_by(policy: Policy, failed: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policies(df: DataFrame, policies: tuple[Policy, ...] = POLICIES, out: str = "ledger", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger with a column kept_<version> for each policy; no text is read."""
    return df.withColumns({f"kept_{p.version}": kept_by(p, F.col(out).getField("failed"), rules) for p in policies})


def ablation(df: DataFrame, policy: Policy = CURRENT, out: str = "ledger", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept if the rule went), and the bits
    that ever fail beside it. One aggregation over at most 2^rules distinct bit sets."""
    failed = F.col(out).getField("failed").bitwiseAND(F.lit(policy.mask(rules)).cast("long"))
    counts = df.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if r.name in policy.rules])
    joined = counts.select("bits", "n", F.inline(named)).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return joined.groupBy("rule", "bit").agg(
        F.sum("n").alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.expr("bit_or(bits)").alias("failed_beside"),
    )


def filter_documents(df: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The input's rows that the policy keeps, with the input's columns."""
    out = free_name(df, "_ledger")
    judged = ledger(df, text_col, out)
    return judged.where(kept_by(policy, F.col(out).getField("failed"))).drop(out)
