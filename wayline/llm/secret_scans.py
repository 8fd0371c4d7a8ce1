"""Secret scans with a randomness test battery.

Base patterns find assignments, access keys and hexadecimal runs. Beyond them, every long token of an encoding's
alphabet (hexadecimal, base 32, lower-case alphanumeric, base 64) is put to tests: chi-squared uniformity over
its alphabet, a runs test about the alphabet's middle, lag-one serial correlation, and changes of character
class. A token counts as random if no test rejects randomness while natural text is rejected; the latter's
p-values are combined and held to a false discovery rate within classes of length (Benjamini-Hochberg over a
histogram, so that no ranking of all tokens is needed).

Everything is a projection of built-in functions over the text's row: no Python on executors, no shuffle but
the histogram's. Positions are code points, ends exclusive.

Defined results: a null or empty text has no spans, and redaction leaves it as it is; repeated rows are judged each
by themselves; only the id and text columns are read; an empty table gives an empty result. Tokens of letters of one
case only are natural text to this operator and not tested, nor are tokens that hold a base span. Work is near
linear in a text's length and in its number of spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"


@dataclass(frozen=True)
class Params:
    rate: float = 0.01  # false discoveries among the added spans, per class of length
    repeat: float = 0.065  # chance that two letters of natural text are equal
    changes: float = 0.15  # changes of character class per step in natural tokens
    reject: float = 3.3  # standard deviations at which randomness is rejected
    lengths: tuple[int, ...] = (24, 32, 48, 64)


BLOCK = 256  # spans that are put together at once
_NONE = "cast(array() AS array<struct<start:int,stop:int,x:string>>)"


def _positions(pattern: str, text: str = "text") -> str:
    """SQL: (start, stop, x) of every leftmost, non-overlapping match of a pattern in an SQL expression.

    Starts are running sums of lengths, taken in blocks and then over the blocks: appending to one array match by
    match would copy it each time.
    """
    p = _literal(pattern)
    return f"""if({text} RLIKE {p}, aggregate(
        transform(
            transform(array(filter(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, x) -> named_struct('gap', length(g), 'x', x)), z -> z.x IS NOT NULL)),
                all_z -> transform(sequence(0, (size(all_z) - 1) div {BLOCK}), i -> slice(all_z, i * {BLOCK} + 1, {BLOCK})))[0],
            some -> aggregate(some, named_struct('at', 0, 'out', {_NONE}),
                (acc, z) -> named_struct('at', acc.at + z.gap + length(z.x), 'out', array_append(acc.out, named_struct('start', acc.at + z.gap, 'stop', acc.at + z.gap + length(z.x), 'x', z.x))))),
        named_struct('at', 0, 'out', cast(array() AS array<array<struct<start:int,stop:int,x:string>>>)),
        (acc, part) -> named_struct('at', acc.at + part.at, 'out', array_append(acc.out, transform(part.out, m -> named_struct('start', acc.at + m.start, 'stop', acc.at + m.stop, 'x', m.x)))),
        acc -> flatten(acc.out)), {_NONE})"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _tests(p: Params) -> list[str]:
    """SQL over arrays of candidates, step by step: each step adds fields to every candidate `c`."""
    by_class = "CASE WHEN v BETWEEN 48 AND 57 THEN 0 WHEN v BETWEEN 65 AND 90 THEN 1 WHEN v BETWEEN 97 AND 122 THEN 2 ELSE 3 END"
    return [
        # the inferred encoding's alphabet size and middle, and the token's codes in the alphabet's order
        """transform(c0, c -> named_struct('start', c.start, 'stop', c.stop, 'n', double(length(c.x)),
            'k', CASE WHEN c.x RLIKE '^[0-9]+$' THEN 10D WHEN c.x RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 16D WHEN c.x RLIKE '^[A-Z2-7]+=*$' THEN 32D WHEN c.x RLIKE '^[a-z0-9]+$' THEN 36D ELSE 64D END,
            'u', transform(split(c.x, ''), v -> ascii(v))))""",
        f"""transform(c1, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'k', c.k, 'u', c.u,
            'g', transform(c.u, v -> {by_class}),
            'y', transform(c.u, v -> CASE WHEN v BETWEEN 48 AND 57 THEN v - 48D WHEN v BETWEEN 65 AND 90 THEN v - 55D WHEN v BETWEEN 97 AND 122 THEN v - IF(c.k = 64D, 61D, 87D) ELSE 62D END),
            'sq', aggregate(array_distinct(c.u), 0D, (acc, d) -> acc + pow(c.n - size(array_remove(c.u, d)), 2))))""",
        """transform(c2, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'k', c.k, 'g', c.g,
            'chi', c.k * c.sq / c.n - c.n, 'y', c.y, 'mean', aggregate(c.y, 0D, (acc, v) -> acc + v) / c.n,
            'hi', transform(c.y, v -> IF(v >= IF(c.k = 32D, 20D, c.k / 2), 1, 0))))""",
        """transform(c3, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n, 'k', c.k, 'chi', c.chi,
            'var', aggregate(c.y, 0D, (acc, v) -> acc + pow(v - c.mean, 2)),
            'lag', aggregate(zip_with(slice(c.y, 1, int(c.n) - 1), slice(c.y, 2, int(c.n)), (a, b) -> (a - c.mean) * (b - c.mean)), 0D, (acc, v) -> acc + v),
            'runs', 1 + aggregate(zip_with(slice(c.hi, 1, int(c.n) - 1), slice(c.hi, 2, int(c.n)), (a, b) -> IF(a <> b, 1, 0)), 0, (acc, v) -> acc + v),
            'n1', double(aggregate(c.hi, 0, (acc, v) -> acc + v)),
            'turns', aggregate(zip_with(slice(c.g, 1, int(c.n) - 1), slice(c.g, 2, int(c.n)), (a, b) -> IF(a <> b, 1, 0)), 0, (acc, v) -> acc + v)))""",
        # deviations from randomness (uniform, runs, serial) and from natural text (natural)
        f"""transform(c4, c -> named_struct('start', c.start, 'stop', c.stop, 'n', c.n,
            'uniform', (c.chi - (c.k - 1)) / sqrt(2 * (c.k - 1)),
            'run', CASE WHEN c.n1 = 0 OR c.n1 = c.n THEN -99D ELSE (c.runs - 1 - 2 * c.n1 * (c.n - c.n1) / c.n)
                / sqrt(greatest(1e-9D, 2 * c.n1 * (c.n - c.n1) * (2 * c.n1 * (c.n - c.n1) - c.n) / (c.n * c.n * (c.n - 1)))) END,
            'serial', IF(c.var <= 0, 99D, c.lag / greatest(c.var, 1e-9D) * sqrt(c.n)),
            'natural', ((c.chi - (c.k - 1) - c.n * greatest(c.k * {p.repeat}D - 1, 0.5D)) / sqrt(2 * (c.k - 1) + 4 * c.n * greatest(c.k * {p.repeat}D - 1, 0.5D))
                - (c.turns - (c.n - 1) * {p.changes}D) / sqrt((c.n - 1) * {p.changes * (1 - p.changes)}D)) / sqrt(2D)))""",
        # the normal distribution's lower tail, as a logistic curve
        f"""transform(c5, c -> named_struct('start', c.start, 'stop', c.stop,
            'len', {' + '.join(f'IF(c.n >= {x}, 1, 0)' for x in p.lengths)},
            'random', c.uniform <= {p.reject}D AND abs(c.run) <= {p.reject}D AND abs(c.serial) <= {p.reject}D,
            'bin', int(floor(-10 * log10(greatest(1e-30D, 1 / (1 + exp(least(200D, -(1.5976D * c.natural + 0.07056D * pow(c.natural, 3)))))))))))""",
    ]


def scan(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `base` (start, kind, stop) in order, and `tested`, the other candidates with their results."""
    return _scan(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), p, "id")


def _scan(out: DataFrame, p: Params, carry: str) -> DataFrame:
    found = {
        "assign": f"filter(given, m -> length(regexp_extract(m.x, {_literal(ASSIGN)}, 2)) >= 6)",
        "access": _positions(ACCESS),
        "hex": _positions(HEX),
    }
    base = "array_sort(concat(" + ", ".join(f"transform({found[k]}, m -> named_struct('start', m.start, 'kind', {i}, 'stop', m.stop))" for i, k in enumerate(BASE_KINDS)) + "))"
    # tokens are looked for in what assignments leave; those that hold another base span are none
    gaps = f"zip_with(split(text, {_literal(ASSIGN)}, -1), concat(array(0), transform(given, m -> m.stop)), (g, o) -> named_struct('g', g, 'o', o))"
    tokens = f"flatten(transform({gaps}, z -> transform({_positions(TOKEN, 'z.g')}, m -> named_struct('start', m.start + z.o, 'stop', m.stop + z.o, 'x', m.x))))"
    mixed = "m.x RLIKE '[0-9]' OR m.x RLIKE '^[^a-z]*+[a-z][^A-Z]*+[A-Z]'"
    token = f"if(text RLIKE {_literal(TOKEN)}, filter({tokens}, m -> ({mixed}) AND NOT m.x RLIKE {_literal(HEX)} AND NOT m.x RLIKE {_literal(ACCESS)}), {_NONE})"
    out = out.withColumn("given", F.expr(_positions(ASSIGN)))
    out = out.select(carry, F.expr(base).alias("base"), F.expr(token).alias("c0"))
    for i, step in enumerate(_tests(p)):
        out = out.select(carry, "base", F.expr(step).alias(f"c{i + 1}"))
    return out.withColumnRenamed(f"c{len(_tests(p))}", "tested")


def thresholds(tested: DataFrame, p: Params = Params()) -> dict[int, int]:
    """Per class of length the least bin (of -10 log10 p) that keeps the false discovery rate."""
    # at most (len(lengths) + 1) * 301 rows
    counts = tested.select(F.explode("tested").alias("c")).groupBy("c.len", "c.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for c in range(len(p.lengths) + 1):
        own = sorted(((r["bin"], r["n"]) for r in counts if r["len"] == c), reverse=True)
        total, so_far, least = sum(n for _, n in own), 0, 10_000
        for b, n in own:
            so_far += n
            if 10 ** (-b / 10) <= p.rate * so_far / total:
                least = b
        out[c] = least
    return out


def detect(df: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, `base` and `spans`, arrays of (start, kind, stop) by start, then kind."""
    tested = materialize(scan(df, p, id_col, text_col), "secret-spans")
    return tested.select(F.col("id").alias(id_col), "base", _accepted(tested, p).alias("spans"))


def _accepted(tested: DataFrame, p: Params) -> Column:
    """Base spans and the added ones, by start, then kind."""
    least = F.array(*[F.lit(x) for x in thresholds(tested, p).values()])
    added = F.filter("tested", lambda c: c.random & (c.bin >= F.element_at(least, c["len"] + 1)))
    return F.array_sort(F.concat("base", F.transform(added, lambda c: F.struct(c.start.alias("start"), F.lit(KINDS.index("random")).alias("kind"), c.stop.alias("stop")))))


def redact(df: DataFrame, p: Params = Params(), text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The input with each span (overlapping ones as one) replaced; length_col follows the text where it changed."""
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tested = materialize(_scan(rows, p, "row"), "secret-rows")
    found = tested.select("row", _accepted(tested, p).alias("spans"))
    # block by block, each over its own stretch of the text: reaching a place in a text costs the way to it
    blocks = f"transform(sequence(0, (size(spans) - 1) div {BLOCK}), i -> slice(spans, i * {BLOCK} + 1, {BLOCK}))"
    whole = f"element_at(array(row), 1).`{text_col}`"
    inner = """aggregate(some, named_struct('at', acc.at, 'out', ''), (one, s) -> named_struct('at', greatest(one.at, s.stop),
        'out', if(s.start >= one.at, concat(one.out, substr(stretch, one.at - acc.at + 1, s.start - one.at), {mark}), one.out)))""".format(mark=_literal(mark))
    step = f"""transform(array(substr({whole}, acc.at + 1, greatest(0, array_max(transform(some, s -> s.stop)) - acc.at))), stretch -> {inner})[0]"""
    cut = F.expr(f"""aggregate({blocks}, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (acc, some) -> transform(array({step}), x -> named_struct('at', x.at, 'out', array_append(acc.out, x.out)))[0],
        acc -> concat(array_join(acc.out, ''), substr({whole}, acc.at + 1)))""")
    changed = F.size("spans") > 0
    new = {text_col: F.when(changed, cut).otherwise(F.col("row").getField(text_col))}
    found = found.select("row", "spans", new[text_col].alias("_new"))
    cols = [F.col("_new").alias(c) if c == text_col else F.when(changed, F.length("_new").cast(df.schema[c].dataType)).otherwise(F.col("row").getField(c)).alias(c) if c == length_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return found.select(*cols)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.stop)), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda i, k: F.size(F.filter("base", lambda s: s.kind == i)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(i, k) for i, k in enumerate(BASE_KINDS)], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
