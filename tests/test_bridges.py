"""Gaps joined: against a search from every dead end, and cases of levels, splits and ends that face each other."""

import math
import random
from collections import defaultdict

from wayline.operators import bridges as B

EDGE = "edge long, a long, b long, meters double, ax double, ay double, bx double, by double, path boolean, level int"


def _line(edge, a, b, ax, ay, bx, by, path=True, level=0):
    return (edge, a, b, math.hypot(bx - ax, by - ay), float(ax), float(ay), float(bx), float(by), path, level)


def _landings(edges, reach=25, own=50):
    degree, near, of = defaultdict(int), defaultdict(list), {}
    for e, a, b, m, ax, ay, bx, by, path, level in edges:
        for n, x, y, to in ((a, ax, ay, b), (b, bx, by, a)):
            degree[n] += 1
            near[n].append((to, m))
            of[n] = x, y, path, level
    out = {}
    for p in degree:
        x, y, path, level = of[p]
        if degree[p] != 1 or not path:
            continue
        cost = {p: 0.0}
        for _ in edges:
            for n in list(cost):
                for to, m in near[n]:
                    if cost[n] + m <= min(own, cost.get(to, math.inf)):
                        cost[to] = cost[n] + m
        best = None
        for e, a, b, m, ax, ay, bx, by, _, lv in edges:
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / m**2))
            d = math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y)
            if lv == level and a not in cost and b not in cost and d <= reach:
                best = min(best or (math.inf,), (round(d, 9), e))
        if best:
            out[p] = best[1]
    return out


def test_landings_against_a_search(spark):
    random.seed(6)
    edges = []
    for i in range(150):
        x, y, w = random.random() * 400, random.random() * 400, random.random() * 6.28
        edges.append(_line(i, 2 * i, 2 * i + 1 if i % 3 else 2 * (i // 2), x, y, x + 40 * math.cos(w), y + 40 * math.sin(w), i % 4 > 0, i % 7 // 5))
    spot = {}
    for k, e in enumerate(edges):  # nodes that two edges share lie in one place
        a, b = spot.setdefault(e[1], e[4:6]), spot.setdefault(e[2], e[6:8])
        edges[k] = _line(e[0], e[1], e[2], *a, *b, e[8], e[9])
    edges = [e for e in edges if e[3] > 0]
    got = {r.p: r.edge for r in B.landings(spark.createDataFrame(edges, EDGE)).collect()}
    assert got == _landings(edges)
    assert len(got) > 10


def test_splits_ends_levels_and_roads(spark):
    edges = [
        _line(1, 1, 2, 0, 0, 200, 0, False),  # a road that three paths end short of, two of them close together
        _line(2, 3, 4, 50, 70, 50, 10),
        _line(3, 5, 6, 50.5, -70, 50.5, -10),
        _line(4, 7, 8, 120, 70, 120, 20),
        _line(5, 9, 10, 160, 70, 160, 10, True, 1),  # a level higher
        _line(6, 11, 12, 199.5, 70, 199.5, 10),  # lands on the road's end
        _line(7, 13, 14, 0, 300, 40, 300), _line(8, 15, 16, 100, 300, 60, 300),  # face each other: one join
        _line(9, 17, 18, 0, 500, 0, 540, False),  # a road's own end stays open
        _line(10, 19, 20, 0, 560, 0, 640, False),
    ]
    df = spark.createDataFrame([*edges, (11, None, 5, 1.0, 0.0, 0.0, 1.0, 1.0, True, 0), (12, 90, 91, 5.0, 0.0, None, 1.0, 1.0, True, 0)], EDGE).selectExpr("*", "1 AS node", "2 AS piece")
    out = B.bridged(df).collect()
    pieces = [(r.piece, r.a, r.b, round(r.meters, 2)) for r in out if r.edge == 1]
    assert sorted(pieces) == [(0, 2, 9, 50.0), (1, 9, 17, 70.0), (2, 17, 4, 80.0)]
    joins = {(r.a, r.b): (round(r.meters, 2), r.factor) for r in out if r.edge is None}
    assert joins == {(8, 9): (10.0, 3.0), (9, 12): (10.01, 3.0), (16, 17): (20.0, 3.0), (4, 24): (10.01, 3.0), (28, 32): (20.0, 3.0)}
    assert {r.edge for r in out} == {None, *range(1, 11)}
    assert B.bridged(spark.createDataFrame([], EDGE)).collect() == []


def test_an_end_gathers_only_edges_that_it_may_use(spark, monkeypatch):
    """A crossing of long ways 40 metres off was gathered whole, though no walk of 50 metres takes one."""
    rows = [(1, 1, 2, 10.0, 0.0, 0.0, 10.0, 0.0, True, 0), (2, 2, 9, 300.0, 10.0, 0.0, 10.0, 300.0, False, 0)]
    rows += [(10 + k, 20, 30 + k, 200.0, -40.0, 0.0, -40.0 - k, 200.0, False, 0) for k in range(5)] + [(3, 50, 51, 100.0, -8.0, -50.0, -8.0, 50.0, False, 0), (4, 52, 53, 100.0, -6.0, -50.0, -6.0, 50.0, False, 1)]
    e = spark.createDataFrame(rows, "edge long, a long, b long, meters double, ax double, ay double, bx double, by double, path boolean, level int")
    gathered = []
    order = B.in_order
    monkeypatch.setattr(B, "in_order", lambda df, *by: (gathered.extend(r.edge for r in df.where("p = 1").collect()), order(df, *by))[1])
    got = [(r.p, r.edge, r.meters) for r in B.landings(e).collect()]
    assert got == [(1, 3, 8.0)] and sorted(gathered) == [1, 2, 3]
