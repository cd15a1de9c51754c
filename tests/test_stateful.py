"""Streams with state that leaves: order, restart and expiry."""

import datetime as dt
import time

import pytest

from reelgrid.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
EVENTS = "dedup_key long, seq long, kind string, force boolean, ts timestamp"


@pytest.fixture(autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, before)


def add(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, out, checkpoint):
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(out).collect()


def event(key, seq, kind, hours, force=False):
    return key, seq, kind, force, T0 + dt.timedelta(hours=hours)


def test_requests_in_order_over_a_restart_and_after_expiry(spark, tmp_path):
    feed, out, place = (str(tmp_path / x) for x in ("feed", "out", "checkpoint"))

    def go():
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(feed)
        rows = run(stateful.ordered_stream(s, ["dedup_key"], stateful.request_rule, "1 hour", dt.timedelta(days=2)), out, place)
        return sorted((r.dedup_key, r.seq, r.action) for r in rows)

    # the status arrives before the request that comes first by time
    add(spark, feed, EVENTS, [event(1, 2, "done", 0.5), event(1, 1, "request", 0.2), event(2, 1, "request", 0.1)])
    add(spark, feed, EVENTS, [event(9, 1, "request", 5)])
    assert go() == [(1, 1, "new"), (2, 1, "new")]
    # the same checkpoint: key 1 is done, key 2 still runs
    add(spark, feed, EVENTS, [event(1, 3, "request", 6), event(1, 4, "request", 6.5, True), event(2, 2, "request", 6)])
    add(spark, feed, EVENTS, [event(9, 2, "done", 12)])
    assert go() == [(1, 1, "new"), (1, 3, "drop"), (1, 4, "new"), (2, 1, "new"), (2, 2, "join"), (9, 1, "new")]
    # three days later nothing is known of key 2
    add(spark, feed, EVENTS, [event(9, 3, "done", 90)])
    add(spark, feed, EVENTS, [event(2, 3, "request", 91)])
    add(spark, feed, EVENTS, [event(9, 4, "done", 100)])
    assert (2, 3, "new") in go()


def test_takes_agree_with_the_rule_over_a_table(spark, tmp_path):
    feed, out, place = (str(tmp_path / x) for x in ("feed", "out", "checkpoint"))
    rows = [event(k, i, ("take", "take", "error", "take", "done", "take")[(i * 7 + k) % 6], i % 5 + i / 100) for k in range(4) for i in range(25)]
    add(spark, feed, EVENTS, rows[::2])
    add(spark, feed, EVENTS, rows[1::2])
    add(spark, feed, EVENTS, [event(99, 1, "done", 50)])
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(feed)
    got = run(stateful.ordered_stream(s, ["dedup_key"], stateful.take_rule, "10 hours"), out, place)
    want = stateful.ordered_rule(spark.createDataFrame(rows, EVENTS), ["dedup_key"], stateful.take_rule).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 8


def test_stable_files_are_told_once(spark, tmp_path):
    feed, out, place = (str(tmp_path / x) for x in ("feed", "out", "checkpoint"))
    schema = "channel string, path string, size long, mtime timestamp"
    old, now = dt.datetime(2024, 1, 1), dt.datetime.now()

    def go(want):
        """Runs until the wanted rows are there: with timers in processing time a stream does not end by itself."""
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        df = stateful.stable_files(s)
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", place)
             .outputMode("append").trigger(processingTime="1 second").start())
        try:
            for _ in range(60):
                time.sleep(1)
                assert q.exception() is None
                done = {x for p in q.recentProgress for x in [p.batchId] if p.numInputRows}
                if len(done) >= want:
                    break
        finally:
            q.stop()
        return sorted((r.path, r.size) for r in spark.read.schema(df.schema).parquet(out).collect())

    add(spark, feed, schema, [("a", "/a/1.mp4", 5, old), ("a", "/a/2.mp4", 0, old), ("a", "/a/3.mp4", 7, now + dt.timedelta(hours=1))])
    add(spark, feed, schema, [("a", "/a/1.mp4", 5, old), ("a", "/a/2.mp4", 9, old)])
    assert go(2) == [("/a/1.mp4", 5), ("/a/2.mp4", 9)]
    add(spark, feed, schema, [("a", "/a/1.mp4", 5, old), ("b", "/b/1.mp4", 1, old)])
    assert go(1) == [("/a/1.mp4", 5), ("/a/2.mp4", 9), ("/b/1.mp4", 1)]
