"""Folds over sorted rows against the kernels that see a whole ride."""

import random

import pytest
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayline.operators import folds, network
from wayline.operators import matching as M
from wayline.operators import reduce as P


@pytest.mark.parametrize("algorithm", ["spacing", "interval", "data_saver", "corridor", "farthest_point", "farthest_point_or_speed"])
def test_fold_keeps_what_the_kernel_keeps(spark, algorithm):
    rng = random.Random(5)
    rows = []
    for ride, n in ((1, 1), (2, 2), (3, 3), (4, 400), (5, 90)):
        lat, lng, t = 47.0 + ride, 8.0, 0
        for seq in range(n):
            lat, lng, t = lat + rng.choice([0.0, 2e-5, 6e-5]), lng + rng.choice([-4e-5, 0.0, 5e-5]), t + rng.choice([1000, 3000])
            rows.append((ride, seq, lat, lng, t, rng.random() * 9))
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lng double, t_ms long, speed double").repartition(7)
    for value in (P.REGISTRY[algorithm][1], 4.0):
        got = {tuple(r) for r in P.reduce_rides(df, algorithm, value).collect()}
        want = set()
        pdf = df.toPandas().sort_values(["ride_id", "seq"])
        for ride, part in pdf.groupby("ride_id"):
            want |= {(ride, int(part["seq"].iloc[i])) for i in P.kept_indices(P.Ride.of(part), algorithm, value)}
        assert got == want
    assert P.reduce_rides(df.where("false"), algorithm).count() == 0
    none = spark.createDataFrame([(9, 0, None, 1.0, 5, 1.0), (9, 1, 1.0, 1.0, 6, 1.0)], df.schema)
    assert [tuple(r) for r in P.reduce_rides(none, algorithm).collect()] == [(9, 1)]


@pytest.mark.parametrize("by_speed", [False, True])
def test_ranges_split_in_rounds_keep_what_the_kernel_keeps(spark, by_speed):
    rng = random.Random(8)
    rows, at = [], [47.0, 8.0]
    for seq in range(500):
        at = [at[0] + rng.random() * 9e-5, at[1] + rng.gauss(0, 4e-5)]
        rows.append((1, seq, at[0], at[1], seq * 1000 + rng.randint(0, 400), rng.random() * 9))
    rows += [(2, s, 1.0, 2.0, s, 1.0) for s in range(60)]
    df = spark.createDataFrame(rows, "ride_id long, seq long, lat double, lng double, t_ms long, speed double").repartition(5)
    got = sorted(map(tuple, P.split_kept(df, 2.0, by_speed, in_task=40).collect()))
    name = "farthest_point_or_speed" if by_speed else "farthest_point"
    pdf = df.toPandas().sort_values(["ride_id", "seq"])
    want = [(ride, int(part["seq"].iloc[i])) for ride, part in pdf.groupby("ride_id") for i in P.kept_indices(P.Ride.of(part), name, 2.0)]
    assert got == want and 20 < len(want) < 490


def test_a_long_corridor_is_held_by_its_hull():
    step, rng, n = folds.corridor(3.0, trim=8), random.Random(9), 600
    points = [(i * 5.0, rng.random() * 2 + (i > 300) * (i - 300)) for i in range(n)]
    got = [s for i, (x, y) in enumerate(points) for s in step(x, y, 0.0, i, i == n - 1)]
    keep, a = [0], 0
    for b in range(2, n):
        if any(folds.off_line(points[a], points[b], p) > 3.0 for p in points[a + 1 : b]):
            a = b - 1
            keep.append(a)
    assert got == [*keep, n - 1] and len(got) < 60


def test_markers_placed_as_by_comparing_all(spark):
    rng = random.Random(10)
    rows = [(g, n, rng.random() * 300 - 150, rng.choice([0.0, 12.0, -12.0, rng.random() * 90])) for g in (1, 2) for n in range(250)] + [(3, 1, None, 1.0), (3, 2, 1.0, 1.0)]
    want = []
    for g in (1, 2, 3):
        kept = []
        for _, n, x, y in sorted((0 if n % 10 == 0 else 1 if n % 5 == 0 else 2, n, x, y) for h, n, x, y in rows if h == g and x is not None):
            if all(abs(x - a) >= 12 or abs(y - b) >= 12 for _, a, b in kept):
                kept.append((n, x, y))
        want += [(g, n) for n, _, _ in kept]
    m = spark.createDataFrame(rows, "group_id long, n long, x double, y double")
    assert sorted(map(tuple, network.placed_markers(m, 12.0).collect())) == sorted(want)
    assert network.placed_markers(m.where("false"), 12.0).count() == 0


def test_sticky_choice_against_a_plain_walk(spark):
    rng = random.Random(6)
    rows = [(ride, seq, s, round(rng.random() * 25, 2)) for ride in (1, 2) for seq in range(120) if rng.random() < 0.9 for s in rng.sample(range(6), rng.randint(1, 4))]
    want = []
    for ride in (1, 2):
        held, at = None, None
        for seq in sorted({r[1] for r in rows if r[0] == ride}):
            near = sorted((d, s) for a, b, s, d in rows if (a, b) == (ride, seq))
            if at is not None and seq != at + 1:
                held = None
            same = [d for d, s in near if s == held]
            held, at = held if same and same[0] <= near[0][0] + 10 else near[0][1], seq
            want.append((ride, seq, held))
    met = spark.createDataFrame(rows, "ride_id long, seq long, segment_id long, d double")
    assert sorted(map(tuple, M.sticky(met).collect())) == want
    assert M.sticky(met.where("false")).count() == 0


def _with_task(batches):
    for b in batches:
        yield b[["ride_id"]].assign(task=TaskContext.get().partitionId())


def test_a_key_stays_whole_over_a_union_of_sides_dealt_by_it(spark):
    few = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40000", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    was = {c: spark.conf.get(c) for c in few}
    try:
        for c, v in few.items():
            spark.conf.set(c, v)
        rows = spark.range(0, 60_000, 1, 2).selectExpr("id * 7919 % 3001 AS ride_id", "id AS n").withColumn("k", F.row_number().over(Window.partitionBy("ride_id").orderBy("n")))
        both = rows.where("k <= 4").select("ride_id", "n", F.lit("a").alias("side")).unionByName(rows.where("k > 4").select("ride_id", "n", F.concat(F.lit("b"), F.repeat(F.md5(F.col("n").cast("string")), 4)).alias("side")))
        dealt = folds.in_order(both, "ride_id", "n")
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan[: plan.index("Union")], "the union's rows are not dealt anew"
        tasks = dealt.mapInPandas(_with_task, "ride_id long, task int").collect()
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    assert len({r.ride_id for r in tasks}) == len(set(tasks)) == 3001 and len(tasks) == 60_000
