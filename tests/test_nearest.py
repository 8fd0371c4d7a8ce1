"""Nearest of many: against all pairs, and by plans that neither sort nor shuffle the pairs."""

import math
import random

from wayline.operators import routes, spatial


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _far(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    u = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - ax - u * dx, y - ay - u * dy)


def test_nearest_segment_of_many_points_of_one_place(spark):
    rng = random.Random(3)
    pts = [(i, (i % 12) * 9.5 - 20, (i % 7) * 11.0 - 30) for i in range(200)] + [(900, 5000.0, 5000.0), (901, None, 1.0)]
    seg = [(k, float(x), float(y), float(x + rng.randint(-15, 15)), float(y + rng.randint(-15, 15))) for k in range(150) for x, y in [(rng.randint(-60, 90), rng.randint(-70, 60))]]
    seg += [(k + 500, *s[1:]) for k, s in enumerate(seg[:40])] + [(-7, *seg[3][1:])]
    p, s = spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(seg, "segment_id long, ax double, ay double, bx double, by double")
    got = {r.id: (r.segment_id, round(r.distance, 6)) for r in spatial.to_segments(p, s).collect()}
    want = {}
    for i, x, y in pts:
        near = [] if x is None else [(round(_far(x, y, *g[1:]), 6), g[0]) for g in seg if _far(x, y, *g[1:]) <= 20]
        if near:
            want[i] = (min(near)[1], min(near)[0])
    assert got == want and len(got) > 100
    assert "SortAggregate" not in _plan(spatial.to_segments(p, s))


def test_nearest_section_keeps_its_pairs_out_of_a_sort(spark):
    pts = spark.createDataFrame([(1, 47.0, 8.0, None), (2, 47.0001, 8.0, 10.0)], "id long, lat double, lng double, heading double")
    idx = spark.createDataFrame([(3, 47.0, 8.0, 0.0), (9, 47.0, 8.0, 0.0), (-4, 47.0001, 8.0, 200.0), (5, 47.0001, 8.0001, 0.0)], "section_id long, lat double, lng double, bearing double")
    out = spatial.nearest_section(pts, idx)
    assert {r.id: r.section_id for r in out.collect()} == {1: 9, 2: 5} and "SortAggregate" not in _plan(out)


def test_sections_within_shuffle_no_pairs_and_broadcast_none(spark):
    pts, idx = spark.range(50).selectExpr("id", "47.0D + id * 1e-5 AS lat", "8.0D AS lng"), spark.range(50).selectExpr("id div 10 AS section_id", "47.0D + id * 1e-5 AS lat", "8.0D AS lng")
    plan = _plan(spatial.within(pts, idx))
    assert "Broadcast" not in plan and "Aggregate" not in plan[: plan.index("Join")]


def test_junctions_are_met_without_a_broadcast_of_exploded_points(spark):
    n = spark.range(1, 60).selectExpr("id AS node", "double(id * 7 % 40) AS x", "double(id * 11 % 40) AS y")
    e = spark.range(1, 60).selectExpr("id AS a", "explode(array(id * 3 % 59 + 1, id * 5 % 59 + 1)) AS b")
    plan = _plan(routes.junction_near(spark.range(30).selectExpr("id", "double(id) AS x", "double(id) AS y"), n, e, 12.0))
    assert "BroadcastHashJoin" not in plan.split("\n")[0] and "Generate" not in plan.split("HashAggregate")[0].split("SortMergeJoin")[0] and "SortMergeJoin [cx" in plan


def test_same_sections_look_near_first(spark, monkeypatch):
    asked, whole = [], routes._same_within
    monkeypatch.setattr(routes, "_same_within", lambda found, s, middle, *more: asked.append((middle, found.count())) or whole(found, s, middle, *more))
    rng = random.Random(8)
    rows = [(k, k % 2, float(rng.randint(0, 60)) / 2, float(rng.randint(0, 60)) / 2, float(rng.randint(0, 359)), float(rng.randint(40, 60)), k % 5 == 0) for k in range(600)]
    cols = "activity long, x double, y double, bearing double, meters double, both_ways boolean"
    f, t = rows[::2], rows[1::2]
    found = spark.createDataFrame([r[:-1] for r in f], "id long, " + cols.replace(", both_ways boolean", ""))
    got = {r.id: (r.record, r.distance) for r in routes.same_section(found, spark.createDataFrame([(r[0], r[1] ^ 1, *r[2:]) for r in t], "record long, " + cols)).collect()}
    want = {}
    for a in f:
        near = []
        for b in t:
            d, off = math.hypot(b[2] - a[2], b[3] - a[3]), abs(a[4] - b[4]) % 360
            off = min(off, 360 - off)
            if b[1] ^ 1 == a[1] and b[5] <= a[5] * 1.4 and b[5] * 1.4 >= a[5] and (off <= 45 or b[6] and off >= 135) and d <= min(10.0, a[5] * 0.3):
                near.append((d, b[0]))
        if near:
            want[a[0]] = (min(near)[1], min(near)[0])
    assert got == want and asked[0] == (0.625, 300) and asked[2][1] < 300
