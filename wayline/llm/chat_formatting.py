"""Chat formatting in budgeted windows.

Turns of a conversation are cut into windows that fit a token budget and never split a turn. Prefix sums of the
turns' tokens choose the spans: a window holds the turns whose start falls into one stride of the prefix sum,
and the stride is short of the room by the longest turn, so a window never outgrows it. Turns of more than half
the room stand alone. Every window after the system turn's own repeats the system turn, then as many of the
turns just before it as the history budget takes; repeated targets are masked, so each assistant turn is under
the loss mask once.

A turn is written as `### Role: text</turn>\\n`. Inside roles and texts a backslash goes before every backslash,
`#`, line end or colon of a role, and the slash of `</turn>`, so no text can hold a mark of the template and the
writing can be undone.

Everything is built from window functions, aggregation and string functions. Defined results: null text and role
are empty; turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have a fixed
order; a null conv_id is a conversation of its own; only the four columns are read; an empty table gives an
empty result. A turn longer than the budget has a window of its own that exceeds it (turns are never cut); beside a system turn of over three quarters of the
budget a window still takes a quarter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"


@dataclass(frozen=True)
class Params:
    budget: int = 1024  # tokens of a window
    history: int = 128  # tokens of repeated turns, at most
    frame: int = 4  # tokens that a turn's marks count for
    target_role: str = "assistant"
    system_role: str = "system"


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/(?=turn>)", r"\\$0")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\#:\n]|(?<=<)/(?=turn>)", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _title(role: Column) -> Column:
    """The role as written: first letter in upper case where lower case undoes that, else as it is after `=`."""
    first = F.substring(role, 1, 1)
    simple = first.rlike("^[a-z]$")
    return F.when(simple, F.concat(F.upper(first), role.substr(F.lit(2), F.length(role)))).otherwise(F.concat(F.lit("="), role))


def _untitle(name: Column) -> Column:
    rest = name.substr(F.lit(2), F.length(name))
    return F.when(F.substring(name, 1, 1) == "=", rest).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), rest))


def windows(df: DataFrame, p: Params = Params()) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, n_tokens, formatted, loss): formatted text and the loss mask, an
    array of (start, stop) in code points of the formatted text."""
    turns = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id")
    turns = turns.withColumn("tokens", (tokens_of(F.col("text")) + p.frame).cast("long"))
    turns = turns.withColumn("pos", F.row_number().over(order))
    is_system = F.col("role") == p.system_role
    turns = turns.withColumn("system", F.min(F.when(is_system, F.struct("pos", "text", "tokens"))).over(whole))
    room = F.greatest(F.lit(p.budget - p.history) - F.coalesce("system.tokens", F.lit(0)), F.lit(p.budget // 4))
    turns = turns.withColumn("room", room).withColumn("big", F.col("tokens") * 2 > F.col("room"))
    turns = turns.withColumn("longest", F.coalesce(F.max(F.when(~F.col("big"), F.col("tokens"))).over(whole), F.lit(0)))
    turns = turns.withColumn("end", F.sum("tokens").over(upto)).withColumn("begin", F.col("end") - F.col("tokens"))
    # small turns by stride of the small turns' prefix sum; a big turn starts a new span and ends it
    turns = turns.withColumn("n_big", F.sum(F.col("big").cast("int")).over(upto))
    turns = turns.withColumn("small_begin", F.sum(F.when(F.col("big"), 0).otherwise(F.col("tokens"))).over(upto) - F.when(F.col("big"), 0).otherwise(F.col("tokens")))
    turns = turns.withColumn("stride", F.when(F.col("big"), -1).otherwise(F.floor(F.col("small_begin") / (F.col("room") - F.col("longest") + 1))).cast("long"))
    fresh = (F.col("pos") == 1) | (F.col("stride") != F.lag("stride").over(order)) | (F.col("n_big") != F.lag("n_big").over(order))
    turns = turns.withColumn("fresh", fresh).withColumn("window", F.sum(F.col("fresh").cast("int")).over(upto) - 1)
    # history: the turns whose begin lies within the budget before this turn's; a system turn is not history
    before = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(-p.history, -1)
    past = F.collect_list(F.when(~is_system, F.struct("pos", "role", "text", "tokens"))).over(before)
    turns = turns.withColumn("past", F.when(F.col("fresh"), past))
    system = F.when(F.col("system.pos") < F.col("pos"), F.array(F.struct(F.col("system.pos").alias("pos"), F.lit(p.system_role).alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"))))
    turns = turns.withColumn("repeated", F.when(F.col("fresh"), F.concat(F.coalesce(system, F.expr("cast(array() AS array<struct<pos:int,role:string,text:string,tokens:bigint>>)")), F.col("past"))))
    grouped = turns.groupBy("conv_id", "window").agg(  # a window's turns: bounded by the budget
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "tokens"))).alias("own"),
        F.flatten(F.collect_list(F.when(F.col("fresh"), F.col("repeated")))).alias("repeated"),
    )
    head = lambda t: F.concat(F.lit("### "), escape_role(_title(t.role)), F.lit(": "))
    piece = lambda t, loss: F.struct(head(t).alias("head"), escape(t.text).alias("body"), loss.alias("loss"), t.tokens.alias("tokens"))
    grouped = grouped.withColumn("pieces", F.concat(F.transform("repeated", lambda t: piece(t, F.lit(False))), F.transform("own", lambda t: piece(t, t.role == p.target_role))))
    tail = len(END) + 1
    mask = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<start:int,stop:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x["head"]) + F.length(x.body) + tail).alias("at"),
            F.when(x.loss, F.array_append(acc.out, F.struct((acc.at + F.length(x["head"])).alias("start"), (acc.at + F.length(x["head"]) + F.length(x.body)).alias("stop")))).otherwise(acc.out).alias("out"),
        ),
        lambda acc: acc.out,
    )
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x.body, F.lit(END + "\n"))), "")
    return grouped.select(
        "conv_id", "window", F.size("repeated").alias("n_repeated"), F.size("own").alias("n_turns"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, x: acc + x.tokens).alias("n_tokens"), text.alias("formatted"), mask.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window: `turns`, its own turns as (role, text), and `targets`, the texts under the loss mask; both
    read from the formatted text."""
    lines = F.filter(F.split("formatted", "</turn>\n", -1), lambda x, i: i >= F.col("n_repeated"))
    lines = F.slice(lines, 1, F.size(lines) - 1)
    # a role holds no bare colon
    turns = F.transform(lines, lambda x: F.struct(_untitle(unescape(F.regexp_extract(x, r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): ", 1))).alias("role"), unescape(F.regexp_replace(x, r"(?s)^### [^\\:]*+(?:\\.[^\\:]*+)*+: ", "")).alias("text")))
    targets = F.transform("loss", lambda m: unescape(F.col("formatted").substr(m.start + 1, m.stop - m.start)))
    return formatted.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.length("formatted").alias("chars"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: counts and digests of what the formatted windows say."""
    read = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    parts = read.select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), F.array_join("targets", "").alias("loss"), "chars")
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    all_of = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    whole = whole.select("conv_id", "n_turns", all_of("said").alias("said"), all_of("loss").alias("loss"), "formatted_chars", "n_windows")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"), F.col("n_windows").cast("long"),
    )
