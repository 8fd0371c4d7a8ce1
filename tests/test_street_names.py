"""Names of streets near points, among ways in a crowd."""

import math
import random

from wayline.operators import routes as R


def _want(points, ways):
    out = {}
    for i, x, y, h in points:
        best = {}
        for ax, ay, bx, by, name, kind in ways:
            dx, dy = bx - ax, by - ay
            if dx or dy:
                u = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                off = abs((math.degrees(math.atan2(dx, -dy)) - h + 540) % 360 - 180)
                d, what, v = math.hypot(x - ax - u * dx, y - ay - u * dy), "name" if name else "kind", name or kind
                if d < 12 and min(off, 180 - off) <= 35:
                    if v:
                        best[what] = min(best.get(what, (d, v)), (d, v))
                    out[i] = tuple(best.get(k, (0, None))[1] for k in ("name", "kind"))
    return out


def test_names_in_a_crowd(spark, monkeypatch):
    """Every point's answer is that of all pairs, and points that have both near by do not meet the ways of the whole reach."""
    rng = random.Random(4)
    ways = []
    for k in range(2500):
        ax, ay = (rng.uniform(0, 300), rng.uniform(0, 300)) if k < 2400 else (rng.uniform(600, 1500), rng.uniform(-500, 0))
        turn, long = rng.choice([0.0, 90.0, rng.uniform(0, 360)]), rng.choice([0.0, 3.0, 60.0])
        ways.append((ax, ay, ax + long * math.cos(math.radians(turn)), ay + long * math.sin(math.radians(turn)), rng.choice([f"S{k}", None]), rng.choice(["path", "track", None])))
    points = [(i, *((rng.uniform(0, 300), rng.uniform(0, 300)) if i < 150 else (rng.uniform(600, 1500), rng.uniform(-500, 0))), rng.uniform(0, 360)) for i in range(250)]
    asked = []
    monkeypatch.setattr(R, "_named_within", lambda p, *a, now=R._named_within: asked.append(p.count()) or now(p, *a))
    w = spark.createDataFrame(ways, "ax double, ay double, bx double, by double, name string, kind string")
    p = spark.createDataFrame(points, "id long, x double, y double, heading double")
    want = _want(points, ways)
    assert {r.id: (r.name, r["kind"]) for r in R.street_names(p, w).collect()} == want and len(want) > 150
    assert asked[0] == 250 > asked[1] > asked[2] > 50
    assert {r.id: (r.name, r["kind"]) for r in R.street_names(p, w, looks=()).collect()} == want
