"""Fingerprints and their join against brute force, and edge cases."""

import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayline.llm import queries, simhash
from wayline.llm.simhash import Params, Ring

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps, ids):
    """The least id reachable, by a search from every row."""
    of = {}
    for n, (fp, i) in enumerate(zip(fps, ids)):
        of.setdefault(("fp", fp), []).append(n)
        if i is not None:
            of.setdefault(("id", i), []).append(n)
    kinds = list({fp for fp in fps})
    near = {a: [b for b in kinds if (a ^ b).bit_count() <= 4] for a in kinds}
    seen, out = set(), {}
    for n in range(len(fps)):
        if n in seen:
            continue
        todo, group = [n], []
        seen.add(n)
        while todo:
            k = todo.pop()
            group.append(k)
            reach = [x for b in near[fps[k]] for x in of[("fp", b)]] + (of[("id", ids[k])] if ids[k] is not None else [])
            for x in reach:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        named = [ids[k] for k in group if ids[k] is not None]
        out.update({k: min(named) if named and ids[k] is not None else None for k in group})
    return [out[n] for n in range(len(fps))]


def _rows(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def _want(rows):
    fps, ids = [_fingerprint(t) for _, t in rows], [i for i, _ in rows]
    return sorted(((-1 if i is None else i), f"{fp:016x}", c) for i, fp, c in zip(ids, fps, _components(fps, ids)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _rows(queries.QUERIES["op13_simhash"](spark, SF)) == _want(rows)


def test_fingerprints_are_sql_s_hash(spark):
    """Spark's xxhash64 is XXH64 of the UTF-8 bytes with seed 42."""
    text = "One two THREE é日 five\vsix x"
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]).decode() for i in range(len(words) - 3)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    assert got == simhash.shingle_hashes(text.encode()).view(np.int64).tolist()


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "word " * 3000), (6, "WORD " * 3000), (6, "word " * 3000), (6, "other words of the same id here"), (None, "null id, some words here to read"), (11, "null id, some words here to read"), (None, "word"), (7, "é" * 50_000), (8, "\x00zero\x00 byte"), (9, "日本語 のテキスト 🎉"), (10, "a b c d"), (12, "a b c d e")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"fp": F.lit(1), "id": F.lit(2), "key": F.lit(3), "side": F.lit("x"), "component_id": F.lit(0)})
    got, _, roots = simhash.join(df)
    assert _rows(simhash.digest(got, roots)) == _want(rows)
    got, _, roots = simhash.join(spark.createDataFrame([], DOCS))
    assert simhash.digest(got, roots).collect() == []


def test_chains_hold_for_every_linked_pair():
    """The principle: some start's prefixes all keep within their budgets, and linked() misses none there."""
    random.seed(3)
    ring = Ring(4)
    assert ring.budget == [0, 1, 2, 3, 4]
    for _ in range(3000):
        a = random.getrandbits(64)
        b = a
        for k in random.sample(range(64), random.randint(1, 4)):
            b ^= 1 << k
        starts = [s for s in range(5) if all((int(ring.mask(s, n)) & (a ^ b)).bit_count() <= ring.budget[n - 1] for n in range(1, 6))]
        assert starts
        one = lambda x: np.array([x], np.uint64)
        assert all(simhash.linked(one(a), one(b), np.array([s]), ring)[0] for s in starts)
        assert not simhash.linked(one(a), one(a ^ 0b11111 << 20), np.array([0]), ring)[0]


@pytest.mark.parametrize("p", [Params(), Params(common=3, block=4), Params(common=1, block=2, pairs=7)])
def test_links_against_brute_force(spark, p):
    """Random fingerprints with near ones: rare and common chains, third segments, blocks."""
    random.seed(7)
    fps = [random.getrandbits(64) for _ in range(60)]
    base = random.getrandbits(64)
    for _ in range(200):
        x = random.choice(fps[:20] + [base])
        for k in random.sample(range(64), random.randint(1, 7)):
            x ^= 1 << k
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    common = simhash.common_chains(df, p)
    assert bool(len(common)) == (p.common < 100)
    links = simhash.links_of(simhash.entries(df, common, p, False), p, ["key"], True)
    if len(common):
        links = links.unionByName(simhash.links_of(simhash.in_blocks(simhash.third_segment(simhash.entries(df, common, p, True), p), p), p, ["key", "x", "y"], False))
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in links.collect()}
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    comp = _components(fps, list(range(len(fps))))
    assert [fps.index(root(x)) for x in fps] == comp
    assert len(set(comp)) > 1


def test_large_groups_return_no_pairs_list(spark):
    """A dense group's links are a forest a task, not its pairs."""
    random.seed(11)
    fps = {sum(1 << k for k in random.sample(range(14), random.randint(0, 6))) for _ in range(1500)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for p in (Params(), Params(common=50, block=64)):
        common = simhash.common_chains(df, p)
        links = simhash.links_of(simhash.entries(df, common, p, False), p, ["key"], True)
        if len(common):
            links = links.unionByName(simhash.links_of(simhash.in_blocks(simhash.third_segment(simhash.entries(df, common, p, True), p), p), p, ["key", "x", "y"], False))
        assert links.distinct().count() < 20 * len(fps)
