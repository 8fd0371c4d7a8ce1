"""Ranks by counts and prefix sums, overlaps by blocks of time, against plain lists."""

import random

from wayline.operators import rides as R


def test_nearest_ranks(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.random() * 10, 3.0, -5.0, float(rng.randrange(4))]), g) for k in ("a", "b", None) for g in range(3) for _ in range(rng.randrange(1, 200))]
    rows += [("one", 7.0, 0), ("same", 2.0, 1), ("same", 2.0, 1), ("none", None, 0), ("a", None, 1)]
    shares = (0.0, 0.1, 0.5, 0.9, 0.95, 1.0)
    got = R.nearest_rank(spark.createDataFrame(rows, "k string, v double, g int"), ["k", "g"], "v", shares).collect()
    want = {}
    for k, g in {(r[0], r[2]) for r in rows}:
        v = sorted(r[1] for r in rows if (r[0], r[2]) == (k, g) and r[1] is not None)
        if v:
            want[(k, g)] = [v[min(len(v) - 1, int(len(v) * q))] for q in shares]
    assert {(r.k, r.g): list(r[2:]) for r in got} == want


def test_overlaps_over_blocks(spark):
    rng = random.Random(5)
    rows = []
    for g in ("a", "b", None):
        t = 0
        for i in range(120):
            t += rng.choice([10, 1000, 86_400_000, 30 * 86_400_000])
            rows.append((i, g, t, rng.choice([t + 5, t + 2000, t + 2 * 86_400_000, t + 40 * 86_400_000, None])))
    rows.append((999, "a", None, 5))
    got = {r.g: (r.overlap, r.n_overlaps) for r in R.overlaps(spark.createDataFrame(rows, "id long, g string, start_ms long, end_ms long").selectExpr("*", "1 AS x"), "g").collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == g and r[2] is not None), key=lambda r: (r[2], r[0]))
        n = sum(p[3] is not None and q[2] < p[3] for p, q in zip(own, own[1:]))
        want[g] = (n > 0, n)
    assert got == want


def test_pace_fractions(spark):
    rows = [(1, "bike", 5.0), (2, "bike", 7.0), (3, "", 9.0), (4, "walk", 1.0), (5, "walk", 1.01), (6, None, None), (7, "hike", -1.0)]
    df = spark.createDataFrame([(i, a, v, 10.0, 1000) for i, a, v in rows], "id int, activity string, avg_speed double, total_distance double, moving_time_ms int")
    assert {r.id: r.fraction for r in R.pace_fraction(df).collect()} == {1: 0.0, 2: 0.4, 3: 0.8, 4: 0.5, 5: 0.5, 6: 1.0, 7: 0.5}
