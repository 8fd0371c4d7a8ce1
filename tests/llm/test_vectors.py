"""The numbered operators over `embeddings`: brute force in plain Python, and edge cases."""

import hashlib
import itertools
import math
import os
import random

import duckdb
import numpy as np
import pytest

from wayline.llm import centroid_clustering, hard_negatives, queries_vectors
from wayline.llm.hard_negatives import Params

SF = "/root/testdata/sf0.001"
VECS = "vec_id long, embedding array<float>, label int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(queries_vectors.QUERIES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(queries_vectors.ORACLES[name])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = queries_vectors.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


# 11


def _clusters(rows, k, rounds, seed=2):
    sound = lambda v: v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if sound(v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    near = lambda v: min((far(v, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(col) // len(vs) for col in zip(*vs)] if vs else m for vs, m in zip(own, c)]
    return sorted((-1 if i is None else i, near(v)[1], near(v)[0]) for i, v in kept), c


def _floats(v):
    return [float(np.float32(x)) for x in v]


def test_bit_planes_are_exact():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(1 << 20), 1 << 20, (9, 64)), rng.integers(-5, 6, (7, 64))
    x[0], x[1] = -(1 << 20), 0
    assert (centroid_clustering.from_planes(centroid_clustering.bit_planes(x, 22)) == x).all()
    assert (centroid_clustering.dot_products(centroid_clustering.bit_planes(x, 22), centroid_clustering.bit_planes(y, 4)) == x @ y.T).all()


def test_clusters_against_brute_force(spark):
    random.seed(5)
    rows = [(i, _floats(random.gauss(i % 3, 0.3) for _ in range(64))) for i in range(60)]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (None, rows[3][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [None] + [0.0] * 63), (504, [float("nan")] * 64), (505, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECS).selectExpr("*", "1 AS cluster", "2 AS planes", "3 AS distance", "4 AS id")
    for k, rounds in ((6, 5), (200, 2), (1, 1)):
        got, c = centroid_clustering.cluster(df, k, rounds)
        want, centroids = _clusters(rows, k, rounds)
        assert sorted((-1 if r.id is None else r.id, r.cluster, r.distance) for r in got.collect()) == want
        assert c.tolist() == centroids
    rows_out = centroid_clustering.digest(got, c).collect()
    assert {r.inertia for r in rows_out} == {sum(d for _, _, d in want)}


def test_clusters_edges(spark):
    assert centroid_clustering.digest(*centroid_clustering.cluster(spark.createDataFrame([], VECS))).collect() == []
    assert centroid_clustering.digest(*centroid_clustering.cluster(spark.createDataFrame([(None, [1.0] * 64, 1)], VECS))).collect() == []
    with pytest.raises(OverflowError):
        centroid_clustering.cluster(spark.createDataFrame([(1, [1e30] * 64, 1)], VECS))


# 12


def _mined(rows, p):
    sound = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, lab, [math.floor(p.scale * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and sound(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (a, lab, v) in enumerate(kept):
        if a % p.every:
            continue
        score = [(-dot(v, w), i, other == lab) for m, (i, other, w) in enumerate(kept) if m != n]
        positives = sorted((s, i) for s, i, same in score if same)[: p.positives]
        for s, i in positives:
            found = sorted((t, j) for t, j, same in score if not same and p.low * -s <= 100 * -t <= p.high * -s)[: p.negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j) in enumerate(found, 1)]
    return sorted(out)


def _got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("p", [Params(every=5, block=7, chunk=4, zones=3, reach=2), Params(every=3, block=64, positives=3, negatives=4, low=0, high=100)])
@pytest.mark.parametrize("kind", ["spread", "clusters", "ties"])
def test_hard_negatives_against_brute_force(spark, p, kind):
    random.seed(8)
    of = {"spread": lambda i: [random.gauss(0, 0.2) for _ in range(8)], "clusters": lambda i: [random.gauss(i % 4 == d, 0.05) for d in range(8)], "ties": lambda i: [float(i % 3), 1.0, 0.0]}[kind]
    rows = [(i, _floats(of(i)), 1 if kind == "ties" and i % 2 else i % 4) for i in range(160)]
    assert _got(hard_negatives.mine(spark.createDataFrame(rows, VECS), p)) == _mined(rows, p)


def test_hard_negatives_edges(spark):
    p = Params(every=5, block=4, chunk=3)
    rows = [(i, [1.0 + i / 100, 1.0, float(i % 2)], i % 2) for i in range(30)]
    rows += [(5, [1.0, 1.0, 1.0], 1), (5, [1.0, 1.0, 1.0], 1), (10, [], 0), (15, [2.0], 1), (None, [1.0] * 3, 0), (40, None, 0), (45, [1.0, None, 1.0], 0), (50, [float("nan")] * 3, 0), (55, [float("inf")] * 3, 0), (60, [1.0] * 3, None), (65, [1.0] * 3, 9)]
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS block", "2 AS chunk", "3 AS id", "4 AS score")
    assert _got(hard_negatives.mine(df, p)) == _mined(rows, p)
    assert hard_negatives.mine(spark.createDataFrame([], VECS)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [1.0, 2.0], 3)], VECS)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(100, [], 3), (101, [], 3)], VECS)).collect() == []
    with pytest.raises(OverflowError):
        hard_negatives.mine(spark.createDataFrame([(100, [1e9] * 64, 3)], VECS))


def test_the_curve_visits_every_cell_once_and_moves_by_one():
    for dims, bits in ((2, 3), (3, 2), (5, 1), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hard_negatives.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, box = rng.integers(-50, 51, (20, 6)), rng.integers(-50, 51, (30, 5, 6))
    low, high = hard_negatives.bounds(a, box.min(1), box.max(1))
    score = np.einsum("ad,zrd->azr", a, box)
    assert (low <= score.min(2)).all() and (score.max(2) <= high).all()


def test_zone_maps_spare_blocks(spark):
    """Clusters far apart: the bounds leave an anchor only blocks of its own cluster."""
    random.seed(9)
    rows = [(i, _floats(random.gauss(2.0 * (i % 8 == d), 0.02) for d in range(8)), i % 8 // 4 * 2 + i // 8 % 2) for i in range(640)]
    df = spark.createDataFrame(rows, VECS)
    p = Params(every=20, block=16, chunk=4)
    whole = df.selectExpr("vec_id AS id", "cast(label AS long) AS label", "transform(embedding, x -> floor(256 * cast(x AS double))) AS v")
    dims, _, spread = hard_negatives._spread(whole)
    store = hard_negatives.blocks(whole, dims, spread, p)
    packs, n, n_blocks = hard_negatives.zone_packs(store, p)
    asked = hard_negatives.chunks(store, dims, p)
    own = hard_negatives.visit(asked, hard_negatives.homes(asked), store, dims, 1, p.positives, True)
    asked = hard_negatives.raised(asked, own, p.positives)
    assert hard_negatives.plan(asked, packs, n, dims, True).count() < 0.5 * asked.count() * n_blocks
    assert _got(hard_negatives.mine(df, p)) == _mined(rows, p)
