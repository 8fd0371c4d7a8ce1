"""Edits of routes against plain lists."""

import random

from wayline.operators import edits as E

STORED = "route_id long, i long, lat double, lng double"
EDIT = "route_id long, n long, op string, at long, lat double, lng double, icon string, title string"


def test_edits_against_plain_lists(spark):
    """Legs as pairs of waypoints: one is still stored if its two waypoints are the same objects, unmoved, as then."""
    rng = random.Random(3)
    stored = [(r, i, float(r), float(i)) for r in range(12) for i in range(r % 5)]
    log, want = [], {}
    for r in range(12):
        points = [["stored", i, float(r), float(i)] for i in range(r % 5)]
        legs = {(id(points[i]), id(points[i + 1])): i for i in range(len(points) - 1)}
        keep, places = list(points), []
        for n in range(40):
            op = rng.choice(["append", "move", "insert", "remove", "remove", "add_place", "move_place", "mark_place", "remove_place", "other"])
            at, spot = rng.randrange(7), [float(n), rng.random()]
            log.append((r, n, op, at, *spot, f"icon{n}", f"title{n}"))
            new = ["new", n, *spot]
            keep.append(new)  # so that no id comes again
            if op == "append":
                points.append(new)
            elif op == "move" and at < len(points):
                points[at] = new
            elif op == "insert" and at < len(points) - 1:
                points.insert(at + 1, new)
            elif op == "remove" and at < len(points):
                points.pop(at)
            elif op == "add_place":
                places.append([*spot, None, ""])
            elif op == "move_place" and at < len(places):
                places[at] = [*spot, *places[at][2:]]
            elif op == "mark_place" and at < len(places):
                places[at] = [*places[at][:2], f"icon{n}", f"title{n}"]
            elif op == "remove_place" and at < len(places):
                places.pop(at)
        pairs = [legs.get((id(a), id(b))) for a, b in zip(points, points[1:])]
        want[r] = [("waypoint", i, *p[2:], None, None, pairs[i] if i < len(pairs) else None, i < len(pairs) and pairs[i] is None) for i, p in enumerate(points)] + [("place", i, *p, None, False) for i, p in enumerate(places)]
    rng.shuffle(log)
    out = E.edited(spark.createDataFrame(stored, STORED), spark.createDataFrame(log, EDIT).selectExpr("*", "1 AS later", "2 AS leg")).collect()
    got = {r: sorted(tuple(x)[1:] for x in out if x.route_id == r) for r in range(12)}
    assert got == {r: sorted(w) for r, w in want.items()}


def test_nulls_and_the_fiftieth_place(spark):
    log = [(1, n, "add_place", None, 1.0, 2.0, None, None) for n in range(60)] + [(None, 1, "append", None, 1.0, 2.0, None, None), (1, None, "append", None, 1.0, 2.0, None, None), (1, 70, "append", None, None, 2.0, None, None), (1, 71, "move", None, 1.0, 1.0, None, None), (1, 72, "mark_place", 3, None, None, None, None), (2, 1, "stored", None, 1.0, 1.0, None, None)]
    out = E.edited(spark.createDataFrame([(None, 1, 1.0, 1.0), (3, 0, None, 1.0)], STORED), spark.createDataFrame(log, EDIT)).collect()
    assert [r.i for r in sorted(out, key=lambda r: r.i)] == list(range(50)) and {r.kind for r in out} == {"place"}
    assert E.edited(spark.createDataFrame([], STORED), spark.createDataFrame([], EDIT)).collect() == []
