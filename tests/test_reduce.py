import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wayline.operators import reduce as P


def _rides(n, sizes):
    rng = np.random.default_rng(5)
    rows = []
    for ride in range(n):
        size = sizes[ride % len(sizes)]
        lat, lng = 40 + np.cumsum(rng.integers(-3, 4, size)) * 1e-5, -105 + np.cumsum(rng.integers(-3, 4, size)) * 1e-5
        rows.append(pd.DataFrame({"ride_id": ride, "seq": np.arange(size), "lat": lat, "lng": lng, "t_ms": np.cumsum(rng.integers(0, 3000, size)), "speed": rng.uniform(0, 9, size)}))
    return pd.concat(rows, ignore_index=True)


def test_many_parameters_keep_what_one_does():
    for _, part in _rides(12, (1, 2, 3, 40, 90)).groupby("ride_id"):
        ride = P.Ride.of(part)
        for algorithm in P.REGISTRY:
            keep = P.keeper(ride, algorithm)
            assert all(keep(v) == P.kept_indices(ride, algorithm, v) for v in (1e-3, 0.4, 1.0, 3.0, 17.0, 200.0, 1e6))


def test_tuning_measures_a_line_once(monkeypatch):
    """22 steps of bisection took 22 runs of each kernel."""
    calls = {a: 0 for a in ("farthest_point", "farthest_point_or_speed", "least_area", "corridor")}

    def counted(a, kernel):
        def run(ride, value):
            calls[a] += 1
            return kernel(ride, value)

        return run

    monkeypatch.setattr(P, "REGISTRY", {a: (counted(a, k) if a in calls else k, v) for a, (k, v) in P.REGISTRY.items()})
    ride = P.Ride.of(_rides(1, (80,)))
    for a in calls:
        _, kept = P._tuned(ride, a, 20)
        assert 10 <= len(kept) <= 30
    assert set(calls.values()) == {0}


def test_splits_leave_near_equal_scores_to_the_kernel():
    ride = P.Ride.of(_rides(1, (30,)))
    ride.x, ride.y = np.arange(30.0), np.zeros(30)
    ride.y[9], ride.y[19] = 1.0, np.nextafter(1.0, 2)
    for tolerance in (0.3, 0.7, 0.9999999999999999, 1.0, 3.0):
        assert P.keeper(ride, "farthest_point")(tolerance) == P.kept_indices(ride, "farthest_point", tolerance)


def test_compare_gives_every_ride_by_every_algorithm(spark):
    pdf = _rides(9, (1, 2, 5, 60))
    df = spark.createDataFrame(pdf).withColumn("lat", F.when((F.col("ride_id") == 4) & (F.col("seq") == 0), None).otherwise(F.col("lat")))
    got = {(r.ride_id, r.algorithm): r.asDict() for r in P.compare(df.repartition(7)).collect()}
    held = {ride: part for ride, part in pdf.groupby("ride_id") if ride != 4}
    assert got.keys() == {(r, a) for r in held for a in P.REGISTRY}
    for (ride, algorithm), row in got.items():
        one = P.Ride.of(held[ride])
        _, kept = P._tuned(one, algorithm, max(2, round(len(one.x) * 0.25)))
        assert (row["n"], row["n_kept"]) == (len(one.x), len(kept))
        assert all(row[s] == v or (v != v and row[s] != row[s]) for s, v in P.scores(one, kept).items())
