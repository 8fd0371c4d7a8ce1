"""Personal data by weak supervision.

One pass over the texts finds the base spans and looser candidates, and lets labelers vote on each candidate:
patterns (checksums, shapes), gazetteers (number prefixes, domain ends) and context words. Distinct vote
patterns are counted (their number is bounded by the votes, not by the corpus), expectation-maximisation
estimates each labeler's reliability from the counts, and its posteriors train a logistic span classifier that
decides which candidates are added. Base spans always stay.

Defined results: a null or empty text has no spans; repeated rows are judged each by themselves; only the id
and text columns are read, so other columns cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_spelled", "ipv6", "card_unchecked", "phone_local", "iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED_AT = re.compile(r"\x20?[\[(](?:at|AT|@)[\])]\x20?")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]+)+")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")
PHONE_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Words before a span that speak for or against personal data, and gazetteers.
FOR = re.compile(r"\b(?:e-?mail|mail|contact|write|phone|tel|telephone|call|mobile|fax|card|visa|credit|account|iban|ssn|social security|ip|host|address)\b")
AGAINST = re.compile(r"\b(?:isbn|issn|version|order|invoice|part|serial|build|id|sku|pi|figure|table|page)\b")
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "io"}
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "2221", "2720")
IBAN_STARTS = {"AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "NO", "PL", "PT", "SE"}
#: labelers, by bit: a checksum or exact form, a gazetteer, context, surroundings that end the span cleanly
LABELERS = ("form", "gazetteer", "context", "edges")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def addresses(text: str, marks: Iterator[tuple[int, int]], local: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping spans of local part, mark, domain. Every mark is looked around once, to the left as
    far as the mark before it: what holds no mark is not read from each of its characters on."""
    free = 0
    for a, b in marks:
        if a < free:
            continue
        before = text[free:a]
        start = len(before.rstrip(local)) + free
        if start < a and (m := domain.match(text, b)):
            yield start, m.end()
            free = m.end()
        else:
            free = b


def quads(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping spans of four dotted numbers, parts at most 255: a run of dotted numbers holds one
    for every four, counted from its start."""
    for run in NUMBERS.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := y.lstrip("0")) <= 3 and int(x or "0") <= 255 for y in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds: by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", *x) for x in addresses(text, (m.span() for m in re.finditer("@", text)), LOCAL + "%", DOMAIN)]
    if "." in text:
        out += [("ip", *x) for x in quads(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans in order that do not overlap, those that touch none of the taken ones, by one sweep over both."""
    out, k, far = [], 0, 0
    taken = sorted(taken)
    for a, b in found:
        while k < len(taken) and taken[k][0] < b:
            far = max(far, taken[k][1])
            k += 1
        if far <= a:
            out.append((a, b))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that touch no base span nor a candidate of a kind before theirs."""
    found: dict[str, list[tuple[int, int]]] = {}
    if "[" in text or "(" in text:
        found["email_spelled"] = list(addresses(text, (m.span() for m in SPELLED_AT.finditer(text)), LOCAL, SPELLED_DOMAIN))
    if ":" in text:
        found["ipv6"] = [m.span() for m in IPV6.finditer(text)]
    found["iban"] = [m.span() for m in IBAN.finditer(text)]
    found["ssn"] = [m.span() for m in SSN.finditer(text)]
    found["phone_local"] = [m.span() for m in PHONE_LOCAL.finditer(text)]
    found["card_unchecked"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(re.sub(r"[ -]", "", m[0])) <= 19]
    taken, out = [(a, b) for _, a, b in base], []
    for kind, spans in found.items():
        spans = _apart(spans, taken)
        taken += spans
        out += [(kind, *x) for x in spans]
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """Bits of the labelers that vote for, and against; the others abstain."""
    span, before = text[a:b], text[max(0, a - 40) : a].lower()
    digits = re.sub(r"[^0-9]", "", span)
    form = gazetteer = 0
    if kind in ("card", "card_unchecked"):
        form = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_STARTS) else -1
    elif kind in ("email", "email_spelled"):
        form = 1 if len(span) <= 254 else -1
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in DOMAIN_ENDS else 0
    elif kind == "ip":
        form = 1 if all(str(int(x)) == x for x in span.split(".") if len(x) < 9) else -1
        gazetteer = -1 if span.startswith(("0.", "127.")) else 0
    elif kind == "iban":
        form = 1 if iban_ok(span) else -1
        gazetteer = 1 if span[:2] in IBAN_STARTS else -1
    elif kind == "ssn":
        form = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
    elif kind in ("phone", "phone_local"):
        form = 1 if 10 <= len(digits) <= 13 else 0
        gazetteer = 1 if span[0] in "+(" else 0
    elif kind == "ipv6":
        form = 1 if span.count(":") == 7 else 0
    context = 1 if FOR.search(before) else -1 if AGAINST.search(before) else 0
    edge = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
    given = (form, gazetteer, context, 1 if edge else -1)
    return sum(1 << i for i, v in enumerate(given) if v > 0), sum(1 << i for i, v in enumerate(given) if v < 0)


SPAN = "struct<kind:int,start:int,stop:int,base:boolean,code:int>"
_SPAN_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])


def code_of(kind: int, plus: int, minus: int) -> int:
    return (kind << 8) | (plus << 4) | minus


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id and `found`: base spans and candidates, each with its votes as a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                if not text:
                    rows.append([])
                    continue
                base = base_spans(text)
                both = [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]
                rows.append([{"kind": (k := KINDS.index(s[0])), "start": s[1], "stop": s[2], "base": is_base, "code": code_of(k, *votes(text, *s))} for s, is_base in both])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, pa.list_(_SPAN_TYPE))], names=["id", "found"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, found array<{SPAN}>")


@dataclass
class Model:
    """Labeler reliabilities (labeler x class x vote) and the classifier's weights."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray
    accepted: list[int]


def _features(codes: np.ndarray) -> np.ndarray:
    kind, plus, minus = codes >> 8, (codes >> 4) & 15, codes & 15
    bits = [(x >> i) & 1 for x in (plus, minus) for i in range(len(LABELERS))]
    return np.column_stack([np.ones(len(codes)), *[kind == k for k in range(len(KINDS))], *bits]).astype(float)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 60, threshold: float = 0.5) -> Model:
    """EM over vote patterns, then logistic regression on the posteriors. Input: distinct codes and counts."""
    codes, counts = np.asarray(codes, np.int64), np.asarray(counts, float)
    n = len(LABELERS)
    if not len(codes):
        return Model(np.full((n, 2, 3), 1 / 3), np.full(len(KINDS), 0.5), np.zeros(1 + len(KINDS) + 2 * n), [])
    kind = codes >> 8
    vote = np.stack([1 + ((codes >> (4 + i)) & 1) - ((codes >> i) & 1) for i in range(n)])  # 0 against, 1 abstains, 2 for
    score = (vote - 1).sum(0)
    post = 1 / (1 + np.exp(-(score - 0.5)))
    for _ in range(rounds):
        prior = (np.bincount(kind, counts * post, len(KINDS)) + 1) / (np.bincount(kind, counts, len(KINDS)) + 2)
        rel = np.ones((n, 2, 3))  # smoothed by one of each
        for i in range(n):
            for v in range(3):
                hit = vote[i] == v
                rel[i, 1, v] += (counts * post)[hit].sum()
                rel[i, 0, v] += (counts * (1 - post))[hit].sum()
        rel /= rel.sum(2, keepdims=True)
        log = np.log(prior[kind] / (1 - prior[kind]))
        for i in range(n):
            log = log + np.log(rel[i, 1, vote[i]] / rel[i, 0, vote[i]])
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    x, w = _features(codes), np.zeros(1 + len(KINDS) + 2 * n)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - post)) + 0.1 * w
        hess = (x * (counts * (p * (1 - p)))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    chance = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return Model(rel, prior, w, sorted(int(c) for c in codes[chance >= threshold]))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.stop)), ",")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """Per row: id, `base` and `spans` (arrays of spans by kind, then start), and the fitted model."""
    found = materialize(scan(df, id_col, text_col), "pii-spans")
    # at most |kinds| * 2^(2 * labelers) rows, whatever the corpus
    seen = found.select(F.explode("found").alias("s")).groupBy("s.code").count().collect()
    model = fit(np.array([r["code"] for r in seen]), np.array([r["count"] for r in seen]))
    accepted = F.array(*[F.lit(c) for c in model.accepted]) if model.accepted else F.array().cast("array<int>")
    return found.select(
        F.col("id").alias(id_col),
        F.filter("found", lambda s: s.base).alias("base"),
        F.filter("found", lambda s: s.base | F.array_contains(accepted, s.code)).alias("spans"),
    ), model


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in BASE_KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
