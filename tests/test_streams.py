"""The streams, driven to completion over small parquet folders."""

import datetime as dt
import itertools

from reelgrid.streaming import activity, intake

_N = itertools.count()


def run(df, mode="append"):
    df.sparkSession.conf.set("spark.sql.shuffle.partitions", "2")
    name = f"out_{next(_N)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def feed(spark, tmp_path, schema, *batches):
    path = str(tmp_path / "feed")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counters_follow_transitions(spark, tmp_path):
    s = feed(spark, tmp_path, "channel_id long, old_status string, new_status string",
             [(1, None, "pending"), (1, None, "pending")], [(1, "pending", "running")], [(1, "running", "done")])
    last = {}
    for r in run(activity.activity_counters(s), "complete"):
        last[r.status] = r.jobs
    assert last == {"pending": 1, "running": 0, "done": 1}


def test_error_opens_a_hash_again(spark, tmp_path):
    s = feed(spark, tmp_path, "channel_id long, file_hash string, seq long, kind string",
             [(1, "a", 1, "take"), (1, "a", 2, "take"), (2, "a", 3, "take")], [(1, "a", 4, "error"), (1, "a", 5, "take"), (1, "a", 6, "take")])
    assert sorted(r.seq for r in run(intake.dedup_stream(s))) == [1, 3, 5]


def test_requests(spark, tmp_path):
    s = feed(spark, tmp_path, "dedup_key long, seq long, kind string, force boolean",
             [(1, 1, "request", False), (1, 2, "request", False), (1, 3, "done", False), (1, 4, "request", False), (1, 5, "request", True)])
    assert [(r.seq, r.action) for r in sorted(run(intake.request_stream(s)), key=lambda r: r.seq)] == [
        (1, "new"), (2, "join"), (4, "drop"), (5, "new")]


def test_daily_quota(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 19723, i, 2, at) for i in range(4)] + [(2, 19723, i, 1, at) for i in range(3)]
    s = feed(spark, tmp_path, "channel_id long, day long, seq long, daily int, ts timestamp", rows)
    got = sorted((r.channel_id, r.seq) for r in run(intake.daily_quota(s)))
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_claims_expire_by_event_time(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    s = feed(spark, tmp_path, "ledger_id long, kind string, ts timestamp",
             [(1, "take", t0), (2, "take", t0)], [(2, "done", t0 + h)], [(9, "take", t0 + 20 * h)], [(9, "done", t0 + 21 * h)])
    assert [r.ledger_id for r in run(intake.expiring_claims(s))] == [1]


def test_throttle(spark, tmp_path):
    s = feed(spark, tmp_path, "job_id long, at_ms long, step string, fraction double",
             [(1, 0, "a", 0.1), (1, 100, "a", 0.2), (1, 350, "a", 0.3)], [(1, 400, "b", 0.4), (1, 450, "b", 1.0)])
    assert sorted(r.at_ms for r in run(activity.throttled_progress(s))) == [0, 350, 400, 450]


def test_stable_files(spark, tmp_path):
    import os
    import time
    root = tmp_path / "root" / "ch1"
    root.mkdir(parents=True)
    for name, size, age in (("a.mp4", 5, 100), ("new.mp4", 5, -3600), ("empty.mp4", 0, 100), ("x.f137.mp4", 5, 100), ("Part 1.mp4", 5, 100)):
        (root / name).write_bytes(b"x" * size)
        os.utime(root / name, (time.time() - age,) * 2)
    got = run(intake.stable_files(intake.media_listing_stream(spark, str(tmp_path / "root"))))
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.mp4"]
