"""Whole jobs that have no SQL, against brute force over all pairs at the smallest size."""

import heapq
import os

import numpy as np
import pytest

from wayline.operators import graph, spatial
from wayline.plans import catalog, kernel_queries, ride_queries

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def _distances(p, s):
    """Points by samples, in metres, as flat_distance has them."""
    lat, lng, slat, slng = p.lat.values[:, None], p.lng.values[:, None], s.lat.values[None], s.lng.values[None]
    return np.sqrt(((slat - lat) * 110574.0) ** 2 + ((slng - lng) * 111320.0 * np.cos(np.radians((lat + slat) / 2))) ** 2)


@here
def test_all_fixes_meet_all_sections(spark):
    p = ride_queries._points(spark, SF).toPandas()
    s = spatial.samples(ride_queries._sections(spark, SF)).toPandas()
    d = _distances(p, s)
    off = np.abs(p.heading.values[:, None] - s.bearing.values[None]) % 360
    turned = np.minimum(off, 360 - off) > 45
    near = np.where(turned, np.inf, d).min(axis=1)
    want = {int(i): x for i, x in zip(p.id, near) if x <= 25}
    got = {r.id: r.distance for r in catalog.queries()["section_nearest"](spark, SF).collect()}
    assert len(want) > 500 and got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 0.00051 for i in want)

    ids, at = np.unique(s.section_id.values, return_inverse=True)
    least = np.full((len(p), len(ids)), np.inf)
    np.minimum.at(least.T, at, d.T)
    i, j = np.nonzero(least <= 150)
    want = {(int(p.id[a]), int(ids[b])): least[a, b] for a, b in zip(i, j)}
    got = {(r.id, r.section_id): r.distance for r in catalog.queries()["sections_ahead"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 0.00051 for k in want)


@here
def test_all_segments_are_searched_and_crossed(spark):
    q = catalog.queries()
    seg = ride_queries._segments(spark, SF)
    assert seg.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    s = seg.orderBy("segment_id").toPandas()
    a, r = s[["ax", "ay"]].values, s[["bx", "by"]].values - s[["ax", "ay"]].values
    c = spark.read.parquet(f"{SF}/customer.parquet").toPandas().c_custkey.values
    x, y = (c % 101) * 6.5, (c % 83) * 7.5
    qx, qy, long = x[:, None] - a[None, :, 0], y[:, None] - a[None, :, 1], (r**2).sum(1)
    u = np.clip((qx * r[:, 0] + qy * r[:, 1]) / np.where(long > 0, long, 1), 0, 1)
    near = np.sqrt((qx - u * r[:, 0]) ** 2 + (qy - u * r[:, 1]) ** 2).min(axis=1)
    got = {z.id: z.distance for z in q["nearest_segment"](spark, SF).collect()}
    assert got.keys() == {int(i) for i, d in zip(c, near) if d <= 20}
    assert all(abs(got[int(i)] - d) < 0.000051 for i, d in zip(c, near) if d <= 20)

    want = set()
    for _, at in s.groupby("level").indices.items():
        p, v = a[at], r[at]
        cross = v[:, None, 0] * v[None, :, 1] - v[:, None, 1] * v[None, :, 0]
        dx, dy = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
        safe = np.where(cross == 0, np.nan, cross)
        f, g = (dx * v[None, :, 1] - dy * v[None, :, 0]) / safe, (dx * v[:, None, 1] - dy * v[:, None, 0]) / safe
        i, j = np.nonzero((f > 0) & (f < 1) & (g > 0) & (g < 1))
        ids = s.segment_id.values[at]
        want |= {(int(ids[k]), int(ids[m])) for k, m in zip(i, j) if ids[k] < ids[m]}
    got = [(z.segment_id, z.other) for z in q["segment_crossings"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_nearest_section_looks_on_and_keeps_ties(spark):
    m = 1 / 110574.0
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 20 * m, 0.0, 90.0), (None, 0.0, 0.0, None), (3, 500 * m, 0.0, None)], "id long, lat double, lng double, heading double")
    index = spark.createDataFrame([(7, 0, m, 0.0, 0.0, 1.0), (8, 0, -m, 0.0, 0.0, 1.0), (9, 0, 0.0, 0.0, 90.0, 1.0)], "section_id long, i int, lat double, lng double, bearing double, speed double")
    got = {r.id: (round(r.distance, 3), r.section_id) for r in spatial.nearest_section(points, index).collect()}
    assert got == {1: (1.0, 8), 2: (20.0, 9), None: (0.0, 9)}


def _dijkstra(edges, source):
    out, done, queue = {}, {}, [(0.0, source)]
    for a, b, cost in edges:
        out.setdefault(a, []).append((b, cost))
    while queue:
        cost, node = heapq.heappop(queue)
        if node not in done:
            done[node] = cost
            for b, step in out.get(node, []):
                heapq.heappush(queue, (cost + step, b))
    return done


def test_shortest_paths_reach_every_node(spark, monkeypatch):
    keys = sorted({1, 2, 3, *range(11, 300, 10), *range(290, 341)})
    far = spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1)
    monkeypatch.setattr(kernel_queries, "read", lambda *a: far)
    edges = [tuple(r) for r in kernel_queries._path_edges(spark, "").select("a", "b", "cost").collect()]
    want = {(s, n): c for s in (1, 2, 3) for n, c in _dijkstra(edges, s).items()}
    got = {(r.source, r.node): r.cost for r in kernel_queries.shortest_path(spark, "").collect()}
    assert got == want and max(n for _, n in want) > 300


def test_shortest_paths_raise_at_their_bound(spark):
    chain = spark.range(5).selectExpr("id AS a", "id + 1 AS b", "1.0D AS cost")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(chain, spark.createDataFrame([(0,)], "source long"), rounds=2)
