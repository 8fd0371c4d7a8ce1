"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words within a sentence) and units after numbers are typed
placeholders, other words are lower-cased and lose their punctuation. Windows of five template words of every
document are hash-joined with the benchmark's. A document leaks an item if it holds enough of the item's windows
and fills its slots consistently: every slot value of the item always stands for the same value in the document,
so a re-parameterised question is found and unrelated text of the same shape is not.

The benchmark's windows are broadcast if the benchmark's size, which is measured, is within `broadcast_bytes`;
beyond it the join is a shuffled one. Everything is built-in functions. Defined results: null and empty texts
have no windows, items of fewer than five words and windows of fewer than two plain words identify nothing and
are not searched; repeated rows of documents give repeated evidence, not repeated output; null ids are ids like
others; only id and text columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

NAME_MARK, UNIT_MARK = "\x01", "\x02"
EQUAL, WHOLE = 0, -1  # what stands for a band's width
# Units that follow a number.
UNITS = ("km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "miles", "mile", "feet", "ft", "inches", "hours", "hour", "minutes", "minute", "seconds", "days", "day", "weeks", "years", "year", "dollars", "euros", "cents", "percent", "litres", "liters", "ml", "degrees", "mph", "kmh")


@dataclass(frozen=True)
class Params:
    span: int = 5
    share: float = 0.6  # of an item's windows that a leak holds
    plain: int = 2  # plain words that a window needs
    drift: int = 64  # widest band of shifts that is one alignment; bands double from one shift on
    broadcast_bytes: int = 16 << 20


def template_words(text: Column) -> Column:
    """Words with marks: a name starts with NAME_MARK, a unit with UNIT_MARK, a number with a digit."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x02]", " ")
    t = F.regexp_replace(t, r"(?<=[^.!?:\s\"'(][\x20])(?=\p{Lu}\p{Ll})", NAME_MARK)
    t = F.regexp_replace(t, r"(?i)(?<=[0-9]\x20)(?=(?:" + "|".join(UNITS) + r")\b)", UNIT_MARK)
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\x01\x02\s]+", "")
    return F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")


def canonical(word: Column) -> Column:
    return F.when(word < "\x02", "<name>").when(word < "\x03", "<unit>").when((word >= "0") & (word < ":"), "<number>").otherwise(word)


def _windows(df: DataFrame, text: Column, p: Params, keep: list[str], slots: str | None = None) -> DataFrame:
    """(keep.., at, key, words): every window's position and hash; words: the whole text's words, which no exchange
    may carry. With `slots`, a column of that name has the window's own slots instead."""
    split = df.select(*keep, template_words(text).alias("words"))
    hashed = split.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(canonical(w))).alias("h"))
    last = F.size("h") - (p.span - 1)
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.expr("cast(array() AS array<int>)"))
    key = lambda i: F.xxhash64(*[F.element_at("h", i + k) for k in range(p.span)])
    if slots is None:
        return hashed.select(*keep, "words", F.posexplode(F.transform(places, key)).alias("at", "key"))
    both = F.transform(places, lambda i: F.struct(key(i).alias("key"), _slots(F.col("words"), i - 1, p).alias(slots)))
    return hashed.select(*keep, F.posexplode(both).alias("at", "window")).select(*keep, "at", "window.*")


def _slots(words: Column, at: Column, p: Params) -> Column:
    """A window's words, with the plain ones empty."""
    return F.transform(F.slice(words, at + 1, p.span), lambda w: F.when((w < "\x03") | ((w >= "0") & (w < ":")), w).otherwise(""))


def _bands(p: Params) -> Column:
    """The alignments that a met window may belong to, as (width, place): bands of shifts, from one shift to `drift`,
    each width but the first laid twice, by half a width apart; windows with equal slots; all windows."""
    lay = lambda width, by: F.struct(F.lit(2 * width + (by > 0)).alias("width"), F.floor((F.col("shift") + by) / width).alias("place"))
    widths = [1 << k for k in range(1, p.drift.bit_length())]
    bands = [lay(1, 0), *[lay(w, by) for w in widths for by in (0, w // 2)]]
    alone = lambda width: F.struct(F.lit(width).alias("width"), F.lit(0).cast("long").alias("place"))
    same = F.array(alone(EQUAL))
    return F.concat(F.array(*bands, alone(WHOLE)), F.when(F.col("item_slots") == F.col("doc_slots"), same).otherwise(F.slice(same, 1, 0)))


def leaks(documents: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_windows, n_found, share, n_slots, exact): one row per document and item that it leaks."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    w = _windows(items, F.col("text"), p, ["item"])
    w = w.select("item", "key", F.col("at").alias("item_at"), _slots(F.col("words"), F.col("at"), p).alias("item_slots"))
    plain = F.size(F.filter("item_slots", lambda x: x == ""))
    w = w.where(plain >= p.plain)
    totals = w.groupBy("item").agg(F.countDistinct("key").alias("n_windows"))
    w = w.join(totals, "item")
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("body"))
    if size <= p.broadcast_bytes:
        # few windows meet an item's, so slots are read from the words where they do
        met = _windows(docs, F.col("text"), p, ["doc", "body"]).join(F.broadcast(w), "key").withColumn("doc_slots", _slots(F.col("words"), F.col("at"), p))
    else:
        met = _windows(docs, F.col("text"), p, ["doc", "body"], "doc_slots").join(w.hint("merge"), "key")
    met = met.select("doc", "item", "n_windows", "body", "key", (F.col("at") - F.col("item_at")).alias("shift"), "item_slots", "doc_slots")
    hits = met.groupBy("doc", "item", "n_windows").agg(F.collect_set(F.struct("body", "shift", "key", "item_slots", "doc_slots")).alias("hits"))  # bounded by the document's windows and the item's repeats
    hits = hits.where(F.size(F.array_distinct(F.col("hits.key"))) >= F.col("n_windows") * p.share)
    hits = hits.select("doc", "item", "n_windows", F.explode("hits").alias("hit")).select("doc", "item", "n_windows", "hit.*")
    aligned = hits.withColumn("band", F.explode(_bands(p))).withColumn("body", F.when(F.col("band.width") >= 0, F.col("body")))
    found = aligned.groupBy("doc", "item", "n_windows", "body", "band").agg(
        F.countDistinct("key").alias("n_found"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "doc_slots")))).alias("pairs"),
    )
    found = found.where(F.col("n_found") >= F.col("n_windows") * p.share)
    found = found.withColumn("pairs", F.filter("pairs", lambda x: x.item_slots != ""))
    asked = F.size(F.array_distinct(F.transform("pairs", lambda x: x.item_slots)))
    consistent = asked == F.size("pairs")
    exact = F.forall("pairs", lambda x: x.item_slots == x.doc_slots)
    best = F.struct((F.col("band.width") != EQUAL).alias("aligned"), exact.alias("exact"), F.col("n_found"), asked.cast("long").alias("n_slots"))
    found = found.where(consistent).groupBy("doc", "item", "n_windows").agg(F.max(best).alias("best"))
    return found.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_windows", "best.n_found", (F.col("best.n_found") / F.col("n_windows")).alias("share"), "best.n_slots", "best.exact",
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the documents that leak an item."""
    gone = leaks(documents, benchmark, p, id_col, text_col).select(F.col(id_col).alias(free_name(documents, "_gone"))).distinct()
    return documents.join(gone, documents[id_col].eqNullSafe(gone[gone.columns[0]]), "left_anti")
