"""Edge cases that the tables do not show."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from wayline.functions import columns as C
from wayline.operators import graph, lines, matching, reduce, rides, spatial, tracks
from wayline.sources import exchange
from wayline.streaming import live

FIX = "ride_id long, seq long, t_ms long, lat double, lng double, altitude double, speed double, accuracy double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_number_rules(spark):
    df = spark.sql("SELECT * FROM VALUES (-2.5D), (2.5D), (0.0D), (double('nan')), (double('infinity')), (NULL) t(x)")
    out = df.select("x", C.half_up(F.col("x")).alias("r"), C.finite(F.col("x")).alias("f")).collect()
    assert [r["f"] for r in out] == [True, True, True, False, False, False]
    assert [r["r"] for r in out[:3]] == [-2, 3, 0]


def test_texts(spark):
    df = spark.createDataFrame([(0,), (29_999,), (30_000,), (3_600_000,), (3_900_000,)], "ms long")
    assert [r[0] for r in df.select(C.duration_minutes(F.col("ms"))).collect()] == ["<1m", "<1m", "1m", "1h", "1h 5m"]
    assert [r[0] for r in df.select(C.clock(F.col("ms"))).collect()] == ["00:00", "00:29", "00:30", "01:00:00", "01:05:00"]
    html = spark.createDataFrame([("<a href='x'>\"&amp;\"</a>",)], "t string")
    assert html.select(C.escape_html(F.col("t"))).first()[0] == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;amp;&quot;&lt;/a&gt;"


def test_moving_time_ignores_unmatched_pauses_and_open_ends(spark):
    fixes = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, None, 1.0, None), (1, 1, 10_000, 0.0, 0.001, None, 1.0, None), (1, 2, 20_000, 0.0, 0.002, None, 1.0, None)], FIX)
    pauses = spark.createDataFrame([(1, 2_000, 4_000), (1, 15_000, None), (2, 0, 99)], "ride_id long, start long, stop long")
    got = tracks.moving(tracks.steps(fixes), pauses).select("seq", "step_ms")
    assert rows(got) == [(0, 0), (1, 8_000), (2, 5_000)]


def test_operators_on_empty_tables(spark):
    empty = spark.createDataFrame([], FIX)
    pauses = spark.createDataFrame([], "ride_id long, start long, stop long")
    ran = tracks.running(tracks.moving(tracks.steps(empty), pauses))
    for df in (tracks.totals(ran), tracks.splits(ran), tracks.split_markers(ran), tracks.band_runs(tracks.steps(empty)), tracks.stable_start(empty), tracks.climb(empty), reduce.reduce_rides(empty, "corridor")):
        assert df.count() == 0


@pytest.mark.parametrize("algorithm", sorted(reduce.REGISTRY))
def test_reduction_keeps_ends_and_corners(algorithm):
    lat = np.concatenate([np.zeros(50), np.arange(50) * 1e-4])
    lng = np.concatenate([np.arange(50) * 1e-4, np.full(50, 49e-4)])
    ride = reduce.Ride.of(pd.DataFrame({"lat": lat, "lng": lng, "t_ms": np.arange(100) * 1000, "speed": np.ones(100)}))
    kept = reduce.kept_indices(ride, algorithm, reduce.REGISTRY[algorithm][1])
    assert kept[0] == 0 and kept[-1] == 99 and kept == sorted(set(kept))
    if algorithm in ("farthest_point", "least_area", "corridor", "data_saver"):
        assert any(48 <= k <= 51 for k in kept) and len(kept) < 20
    for n in (0, 1, 2):
        assert reduce.kept_indices(reduce.Ride.of(pd.DataFrame({"lat": lat[:n], "lng": lng[:n], "t_ms": np.arange(n), "speed": np.ones(n)})), algorithm, 1.0) == list(range(n))


def test_components_of_chains_and_loops(spark):
    nodes = spark.range(0, 60).selectExpr("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40)], "a long, b long")
    got = dict(rows(graph.components(nodes, edges)))
    assert all(got[i] == 0 for i in range(21)) and got[32] == 30 and got[40] == 40 and got[59] == 59


def test_share_links(spark):
    assert spark.sql("SELECT 1").select(exchange.encode_numbers(F.array(F.lit(0), F.lit(-1), F.lit(16), F.lit(-500_000)))).count() == 1
    links = spark.createDataFrame([(1, "#r1=A"), (2, "#r1=!!!!"), (3, "#r1=g"), (4, "#x"), (5, "#r1=")], "ride_id long, link string")
    assert exchange.read_share_text(links).count() == 0


def test_gpx_edge_cases(spark):
    good = '<gpx><trk><trkseg><trkpt lat="1" lon="2"/><trkpt lat="1.5" lon="2"><time>2020-01-01T00:00:01Z</time></trkpt><trkpt lat="x" lon="2"/></trkseg></trk></gpx>'
    got = exchange.read_gpx(spark.createDataFrame([(1, good), (2, "no xml"), (3, None)], "ride_id long, gpx string"))
    assert rows(got.select("ride_id", "seq", "lat", "t_ms")) == [(1, 0, 1.0, 1577836801000), (1, 1, 1.5, 1577836801000)]


def test_backup_versions(spark):
    texts = spark.createDataFrame([('{"version":1,"sessions":[{"id":1},{"id":2}]}',), ('{"version":2,"sessions":[{"id":3}]}',), ("{",)], "json string")
    assert rows(exchange.read_backup(texts, "id bigint")) == [(1,), (2,)]


def test_preferences_fall_back(spark):
    got = rides.preferences(spark.createDataFrame([("a", "x"), ("b", "bad")], "key string, value string"), {"a": (("x",), "d"), "b": (("y",), "y"), "c": (("z",), "z")})
    assert rows(got) == [("a", "x"), ("b", "y"), ("c", "z")]


def test_event_time_windows(spark):
    fixes = spark.createDataFrame([(1, 0), (2, 1_000), (1, 400_000)], "ride_id long, t_ms long")
    assert sorted(r["n"] for r in live.windowed_activity(fixes).collect()) == [1, 2]


def test_values_along_a_ride(spark):
    ran = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 100.0, 20.0), (1, 2, 100.0, 30.0)], "ride_id long, seq long, cum_m double, v double")
    asked = spark.createDataFrame([(1, 7, -5.0), (1, 8, 50.0), (1, 9, 999.0), (2, 1, 0.0)], "ride_id long, id long, d double")
    got = {(r.ride_id, r.id): r.value for r in lines.value_along(ran, asked, "v").collect()}
    assert got == {(1, 7): 10.0, (1, 8): 15.0, (1, 9): 30.0, (2, 1): None}


def test_sticky_matching_prefers_the_segment_before(spark):
    segments = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 50.0, 5.0, 150.0, 5.0)], "segment_id long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 0, 10.0, 1.0), (1, 1, 60.0, 4.0), (1, 2, 120.0, 4.0), (1, 3, 500.0, 0.0), (1, 4, 60.0, 4.0)], "ride_id long, seq long, x double, y double")
    assert rows(matching.match(points, segments)) == [(1, 0, 1), (1, 1, 1), (1, 2, 2), (1, 4, 2)]
    assert matching.match(points.limit(0), segments).count() == 0


def test_spatial_joins_at_cell_borders(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.column_stack([60 + rng.random(80) * 2e-3, 179 + rng.random(80) * 2e-3]))]
    idx = [(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(np.column_stack([60 + rng.random(80) * 2e-3, 179 + rng.random(80) * 2e-3]))]
    got = spatial.within(spark.createDataFrame(pts, "id long, lat double, lng double"), spark.createDataFrame(idx, "section_id long, lat double, lng double, bearing double"), radius=40.0)
    far = lambda p, s: np.hypot((s[1] - p[1]) * 110574, (s[2] - p[2]) * 111320 * np.cos(np.radians((p[1] + s[1]) / 2)))
    assert {(r.id, r.section_id) for r in got.collect()} == {(p[0], s[0]) for p in pts for s in idx if far(p, s) <= 40.0}


def test_sections_ahead_of_a_rider(spark):
    k = 1 / 110574.0  # degrees a metre
    sections = [  # south to north unless said: id, from metre, to metre north, both ways, speed
        (1, -60.0, -3.0, False, 5.0),  # just ridden
        (2, 0.0, 80.0, False, 5.0),  # the rider's own
        (3, 80.0, 0.0, False, 5.0),  # its twin back
        (4, 90.0, 140.0, False, 5.0),  # ahead, leading away
        (5, 140.0, 90.0, False, 5.0),  # ahead, leading here
        (6, 140.0, 90.0, True, 5.0),  # ahead, both ways
        (7, -140.0, -90.0, True, 5.0),  # behind
        (8, 90.0, 140.0, False, None),  # never timed
        (9, 400.0, 450.0, True, 5.0),  # too far
        (10, -60.0, -3.0, True, 5.0),  # just ridden, and back
    ]
    df = spark.createDataFrame([(i, a * k, 0.0, b * k, 0.0, (a + b) / 2 * k, 0.0, 0.0 if b > a else 180.0, w, v) for i, a, b, w, v in sections], "section_id long, lat double, lng double, lat2 double, lng2 double, mid_lat double, mid_lng double, bearing double, both_ways boolean, speed double")
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 180.0), (3, 0.0, 0.0, None), (4, None, 0.0, 0.0)], "id long, lat double, lng double, heading double")
    got = {}
    for r in spatial.ahead(points, df).collect():
        got.setdefault(r.id, set()).add(r.section_id)
    assert got == {1: {2, 4, 6}, 2: {7, 10}, 3: {2, 4, 6, 7, 10}}
    assert spatial.ahead(points.where("false"), df).count() == 0


def test_scores_of_a_reduction():
    t = np.array([0, 1000, 2000, 4000, 5000, 7000, 8000.0])
    v = np.array([1, 2, 6, 3, 4, 8, 5.0])
    lat = np.array([0, 1, 2, 2, 3, 5, 6]) * 1e-4
    lng = np.array([0, 1, 0, 2, 2, 1, 1]) * 1e-4
    ride = reduce.Ride.of(pd.DataFrame({"lat": lat, "lng": lng, "t_ms": t, "speed": v}))
    kept = [0, 3, 6]
    got = reduce.scores(ride, kept)
    x, y = ride.x, ride.y
    mean = lambda a, b: sum((v[i] + v[i + 1]) / 2 * (t[i + 1] - t[i]) for i in range(a, b)) / (t[b] - t[a])
    at = {0: mean(0, 1), 3: mean(1, 4), 6: mean(4, 6)}
    off, drop, seg = [], [], []
    for a, b in ((0, 3), (3, 6)):
        for i in range(a, b):
            u = max(0, min(1, ((x[i] - x[a]) * (x[b] - x[a]) + (y[i] - y[a]) * (y[b] - y[a])) / ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2)))
            off.append(np.hypot(x[i] - x[a] - u * (x[b] - x[a]), y[i] - y[a] - u * (y[b] - y[a])))
            drop.append(abs(v[i] - at[a] - (at[b] - at[a]) * (t[i] - t[a]) / (t[b] - t[a])))
            seg.append(abs(v[i] - mean(a, b)))
    way = lambda p: sum(np.hypot(x[b] - x[a], y[b] - y[a]) for a, b in zip(p, p[1:]))
    want = {"mean_off": sum(off) / 7, "p95_off": max(off), "max_off": max(off), "length_change": way(kept) / way(range(7)) - 1, "speed_mean": sum(drop) / 7, "speed_max": max(drop), "span_speed_mean": sum(seg) / 7, "span_speed_max": max(seg), "peak_kept": max(at.values()) / 8}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), (got, want)
    assert reduce.scores(reduce.Ride.of(pd.DataFrame({"lat": lat[:1], "lng": lng[:1], "t_ms": t[:1], "speed": v[:1]})), [0]) == {k: float(k == "peak_kept") for k in want}
