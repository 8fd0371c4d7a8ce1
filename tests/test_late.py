"""Doubled and late rows: session windows on a stream, rows kept aside, batches written again."""

import random

from wayline.streaming import late

ROW = "ride_id long, seq long, t_ms long, speed double, arrive long"


def _run(base, gap, wait):
    def run(stream):
        late.stretches(stream, gap, wait).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    return run


def test_stretches_of_a_stream(spark, tmp_path):
    """On time in any order, the stream's stretches are the table's; the last ones wait for the watermark."""
    rng, rows = random.Random(2), []
    for ride in range(4):
        t = 1000 + rng.randrange(5000)
        for seq in range(60):
            t += rng.choice([1000, 4000, 10_000, 10_001, 25_000])
            rows += [(ride, seq, t, float(seq), t + rng.randrange(15_000))] * rng.choice([1, 1, 2])
    rows += [(None, 1, 5000, 1.0, 5000), (1, None, 5000, 1.0, 5000), (9, 1, None, 1.0, 5000)]
    end = max(r[2] for r in rows if r[2]) + 10_000_000
    df = spark.createDataFrame([*rows, (99, 0, end, 0.0, end)], ROW).selectExpr("*", "1 AS at", "2 AS w")
    late.replay(df, str(tmp_path), sorted(rng.sample([r[4] for r in rows], 2)), "arrive", _run(str(tmp_path), 10_000, 30_000))
    want = sorted(tuple(r) for r in late.finished_stretches(df, 10_000).where("ride_id <> 99").collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    assert len(want) > 20 and sum(r[3] for r in want) == 240


def test_late_rows_stay_and_batches_are_written_again(spark, tmp_path):
    base, write = str(tmp_path), None
    batch = lambda *ts: spark.createDataFrame([(1, i, t, 0.0, 0) for i, t in enumerate(ts)], ROW)
    write = late.sorted_out(base, 1000)
    write(batch(5000, 9000, None), 0)
    write(batch(7999, 8000, 8001, 20_000), 1)
    write(batch(8001, 8002), 2)
    write(batch(7999, 8000, 8001, 20_000), 1)  # after a failure
    got = lambda what: sorted((r["batch"], -1 if r.t_ms is None else r.t_ms) for r in spark.read.parquet(f"{base}/{what}").collect())
    assert got("late") == [(1, 7999), (1, 8000), (2, 8001), (2, 8002)]
    assert got("kept") == [(0, -1), (0, 5000), (0, 9000), (1, 8001), (1, 20_000)]


def test_a_replay_deals_each_slice_over_files_in_the_order_of_time(spark, tmp_path):
    from wayline.streaming import live

    fixes = spark.createDataFrame([(r, s, 40.0, -105.0, s * 1000, 1.0) for r in range(8) for s in range(40)], "ride_id long, seq long, lat double, lng double, t_ms long, speed double")
    live.replay(spark, fixes, str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in")).selectExpr("ride_id", "seq", "_metadata.file_path AS f", "_metadata.file_modification_time AS at").collect()
    assert len(rows) == 320 and len({r.f for r in rows}) > 4, "a slice is no single file"
    for ride in range(8):
        files = sorted({(r.at, r.f, r.seq // 10) for r in rows if r.ride_id == ride})
        assert [k for _, _, k in files] == [0, 1, 2, 3]


def test_laps_come_in_by_more_than_three_tasks(spark, monkeypatch):
    from wayline.plans import kernel_queries

    class Read(Exception):
        pass

    def maintain(stream, out, state):
        raise Read(len(spark.read.parquet(out.removesuffix("/out") + "/in").inputFiles()))

    monkeypatch.setattr(kernel_queries.best_pace, "maintain", maintain)
    monkeypatch.setattr(kernel_queries, "lap", lambda spark, d: spark.range(200).selectExpr("id AS ride_id"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        kernel_queries.incremental_best_pace(spark, "")
    except Read as read:
        assert read.args[0] > 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
