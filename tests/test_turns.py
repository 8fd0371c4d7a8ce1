"""Turn steps on drawn junctions."""

from wayline.operators import turns as U

POINT = "route long, i long, x double, y double"


def _steps(spark, points, nodes, edges, ways, reach=1.0):
    s = U.turn_steps(
        spark.createDataFrame([(*p[:2], *(None if v is None else float(v) for v in p[2:])) for p in points], POINT), spark.createDataFrame([(n, float(x), float(y)) for n, x, y in nodes], "node long, x double, y double"),
        spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(*map(float, w[:4]), *w[4:]) for w in ways], "ax double, ay double, bx double, by double, name string, kind string"), reach,
    )
    rows = s.withColumn("said", U.instruction(s["turn"], s["name"], s["kind"], s["stay"])).collect()
    return {k: [(r.i, round(r.along), r.turn, None if r.angle is None else round(r.angle), r.said) for r in sorted(rows, key=lambda r: r.i) if r.route == k] for k in {r.route for r in rows}}


def test_turns_clusters_names_and_arrivals(spark):
    """A crossing at (100, 0), y to the south, and a double one at (200, 0) and (210, 0)."""
    nodes = [(1, 0, 0), (2, 100, 0), (3, 200, 0), (4, 210, 0), (5, 300, 0), (6, 100, -100), (7, 100, 100), (8, 200, -100), (9, 210, 100)]
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (2, 6), (2, 7), (3, 8), (4, 9)]
    ways = [(0, 0, 200, 0, "High Street", None), (100, 0, 100, -100, "Hill", None), (100, 0, 100, 100, None, "path"), (210, 0, 210, 100, "High Street", None), (0, 0, 300, 0, None, "track"), (5, 5, 5, 5, "nothing", None)]
    line = lambda r, *ps: [(r, i, x, y) for i, (x, y) in enumerate(ps)]
    points = (
        line(1, (0, 0), (100, 0), (200, 0))  # straight on
        + line(2, (0, 0), (100, 0), (100, -100))  # left, north
        + line(3, (0, 0), (100, 0), (100, 100))  # right, south, onto a path
        + line(4, (0, 0), (100, 0), (200, 0), (210, 0), (210, 100))  # two nodes, one turn, the street keeps its name
        + line(5, (0, 0), (50, 0), (100, 0), (50, 0))  # back
        + line(6, (98, 0), (100, 0), (100, 100))  # at the start
        + line(7, (0, 0), (60, 0))  # no junction
        + line(8, (0, 0), (100, 0), (170, 70))  # bears off, no name there
        + line(9, (5, 5))
        + [(10, 0, None, 0), (10, 1, 0, 0), (11, None, 0, 0)]
    )
    assert _steps(spark, points, nodes, edges, ways) == {
        1: [(2, 200, "arrive", None, None)],
        2: [(1, 100, "left", -90, "Turn left onto Hill"), (2, 200, "arrive", None, None)],
        3: [(1, 100, "right", 90, "Turn right onto the path"), (2, 200, "arrive", None, None)],
        4: [(2, 200, "right", 90, "Turn right to stay on High Street"), (4, 310, "arrive", None, None)],
        5: [(2, 100, "uturn", 180, "Make a U-turn to stay on High Street"), (3, 150, "arrive", None, None)],
        6: [(2, 102, "arrive", None, None)],
        7: [(1, 60, "arrive", None, None)],
        8: [(1, 100, "slight-right", 45, "Bear right"), (2, 199, "arrive", None, None)],
        9: [(0, 0, "arrive", None, None)],
        10: [(1, 0, "arrive", None, None)],
    }
    assert _steps(spark, [], nodes, edges, ways) == {}


def test_points_at_ends_and_doubled_vertices(spark):
    line = U.measured(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 20.0)], POINT))
    asked = spark.createDataFrame([(1, str(d), float(d)) for d in (-5, 0, 5, 10, 15, 30, 99)], "route long, key string, at double")
    assert {r.key: (r.x, r.y) for r in U.points_at(line, asked).collect()} == {"-5": (0, 0), "0": (0, 0), "5": (5, 0), "10": (10, 0), "15": (10, 5), "30": (10, 20), "99": (10, 20)}
