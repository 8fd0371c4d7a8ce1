"""Rides while they are recorded: any cut into micro-batches gives the finished ride's log; timers; bad rows."""

import math
import random

import pytest

from wayline.plans.live_queries import _log as _log_rows
from wayline.streaming import recorder as R


def _rows(seed, rides=3, n=40):
    """Winding rides with outages, pauses, poor fixes; in the order of time."""
    rng, out = random.Random(seed), []
    for ride in range(rides):
        t, lat, lng, v = 1000 + rng.randrange(3000), 40.0 + ride, -105.0, 5.0
        for seq in range(n):
            out.append((ride, t, 2 * seq, "fix", seq, lat, lng, rng.choice([100.0 + seq, None, float("nan")]), rng.choice([v, v, None, -1.0]), rng.choice([5.0, 8.0, 20.0, 21.0, None])))
            dt = rng.choice([1000, 1000, 2000, 3500, 3501, 6000, 20_000])
            if rng.random() < 0.15:
                out.append((ride, t + 300, 2 * seq + 1, "pause") + (None,) * 6)
                out.append((ride, t + dt - 100, 2 * seq + 1, "resume") + (None,) * 6)
            lat, lng, t = lat + v * dt / 1000 / 111_320, lng + rng.choice([0, 0, 1e-4]), t + dt
    return out


def _log(df, *without):
    return sorted((tuple(-1 if x is None else x for x in r) for r in df.collect() if r.kind not in without), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_gives_the_finished_log(spark, tmp_path, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, R.INPUT)
    rules = R.Rules(split_m=50.0)
    whole = _log(R.recorded(df, rules), "closed")
    assert {r[1] for r in whole} == {"fix", "estimated", "split", "outage"}
    times = sorted({r[1] for r in rows})
    cuts = sorted(random.Random(seed).sample(times, 2))
    live = _log(R.replay(df, str(tmp_path), cuts, rules), "closed")
    ends = {r: max(x[1] for x in rows if x[0] == r and x[3] == "fix") for r in range(3)}
    assert [x for x in live if x[1] != "outage"] == [x for x in whole if x[1] != "outage"]
    told, known = {x for x in live if x[1] == "outage"}, {x for x in whole if x[1] == "outage"}
    assert known <= told
    assert len({(x[0], x[4]) for x in told}) == len(told), "an outage is told once"
    assert all(x[4] > ends[x[0]] - 60_000 for x in told - known), "only what the end of a ride shows"


def test_timers_tell_outages_and_close_quiet_rides(spark, tmp_path):
    fix = lambda ride, t, seq, lat=40.0: (ride, t, 2 * seq, "fix", seq, lat, -105.0, 100.0, 3.0, 5.0)
    rows = [fix(1, 1000, 0), fix(1, 2000, 1, 40.0001), fix(2, 1000, 0), fix(2, 8000, 1), fix(2, 90_000_000, 2), fix(2, 180_000_000, 3)]
    out = R.replay(spark.createDataFrame(rows, R.INPUT), str(tmp_path), [8000, 90_000_000, 180_000_000]).collect()
    assert sorted((r.ride_id, r.kind, r.t_ms) for r in out if r.kind in ("outage", "closed")) == sorted(
        [(1, "outage", 5500), (1, "closed", 86_402_000), (2, "outage", 4500), (2, "outage", 11_500), (2, "closed", 86_408_000), (2, "outage", 90_003_500), (2, "closed", 176_400_000)]
    )
    # the state had gone: the last fixes begin rides of their own
    assert {(r.seq, r.distance_m, r.elapsed_ms) for r in out if r.kind == "fix" and r.t_ms >= 90_000_000} == {(2, 0.0, 0), (3, 0.0, 0)}


def test_rows_without_values(spark):
    fix = (1, 1000, 0, "fix", 0, 40.0, -105.0, 1.0, 2.0, 3.0)
    bad = [(None,) + fix[1:], (1, None) + fix[2:], (1, 1500, 1, None) + fix[4:], (1, 1600, 2, "fix", 1, None, -105.0, 1.0, 1.0, 1.0), (1, 1700, 3, "fix", 2, 40.0, float("nan"), 1.0, 1.0, 1.0), (1, 1800, 3, "resume") + (None,) * 6, (2, 5, 0, "pause") + (None,) * 6, fix]
    df = spark.createDataFrame([fix, *bad], R.INPUT).selectExpr("*", "1 AS heading", "2 AS at")
    assert [(r.ride_id, r.kind, r.distance_m) for r in R.recorded(df).collect()] == [(1, "fix", 0.0), (1, "fix", 0.0)]
    assert R.recorded(spark.createDataFrame([], R.INPUT)).collect() == []


def test_a_bridge_is_accepted_or_discarded():
    rules = R.Rules()
    for north, n in ((65.0, 25), (65.0 + 45, 25), (65.0 + 55, 0), (500.0, 0)):
        r, out = R.Ride(), []
        for seq, (t, m) in enumerate(((0, 0.0), (1000, 10.0), (11_000, 10.0 + north))):
            out += R.step(1, r, (t, "fix", seq, 40.0 + m / 111_195, -105.0, None, 10.0, 5.0), rules)
        assert sum(x[1] == "estimated" for x in out) == n
        assert abs(r.distance_m - 10.0 - north) < 0.5


def test_a_bridge_beyond_a_pole_goes_on():
    """Latitudes count on there, and degrees eastwards are negative: as in the log's SQL."""
    r, out = R.Ride(), []
    for seq, (t, north, east) in enumerate(((0, 0.0, 0.0), (1000, 6.0, 8.0), (11_000, 45.0, 60.0))):
        per_lng = 111_195 * math.cos(math.radians(100.0))
        out += R.step(1, r, (t, "fix", seq, 100.0 + north / 111_195, 20.0 + east / per_lng, None, 10.0, 5.0), R.Rules())
    way = [x for x in out if x[1] == "estimated"]
    assert len(way) == 25
    assert abs(r.distance_m - 75.0) < 1
    assert way[-1][6] - way[0][6] == pytest.approx(24 * 2.5 * math.sin(math.radians(r.heading)) / (111_320 * math.cos(math.radians(100.0))), rel=1e-3)


def test_logs_round_halves_as_their_sql_does(spark):
    """128.5015345 times a million lies just below a half."""
    row = (1, "fix", 0, 0, 0, 128.5015345, 0.0, 0.0, 0, None, 0.0, 0.0, 0.0)
    assert _log_rows(spark.createDataFrame([row], R.LOG)).first()["lat"] == round(128.5015345 * 1e6) / 1e6 == 128.501534
