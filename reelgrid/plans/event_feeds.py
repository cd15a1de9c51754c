"""Batch runs of the streaming rules over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelgrid.functions.clock import local_day
from reelgrid.operators.folds import fold_runs
from reelgrid.operators.scan import last_value, row_number, running_sum, scan
from reelgrid.plans.registry import query
from reelgrid.sources.standins import jobs, ledger, with_tables
from reelgrid.streaming.activity import activity_counters, throttle


@query(with_tables("""select channel_id, status, cast(sum(d) as bigint) as jobs from (select channel_id, status, 1 as d from jobs union all
    select channel_id, prev, -1 from (select channel_id, lag(status) over (partition by channel_id, priority order by job_id) as prev from jobs) where prev is not null) group by all""", "jobs"))
def activity_counts(spark, folder):
    j = jobs(spark, folder).select("channel_id", "priority", "job_id", "status")
    moves = scan(j, ["channel_id", "priority"], ["job_id"], F.floor(F.col("job_id") / 1_000_000), old_status=last_value(F.col("status"), False))
    return activity_counters(moves.withColumnRenamed("status", "new_status"))


@query(with_tables("""select finished_at // 86400 as day, count_if(status = 'done') as done, count_if(status = 'failed') as failed from jobs where finished_at is not null group by 1""", "jobs"))
def tumbling_status_counts(spark, folder):
    day = F.datediff(local_day(F.col("finished_at")), F.lit("1970-01-01").cast("date")).cast("long")
    return (jobs(spark, folder).filter("finished_at is not null").groupBy(day.alias("day"))
            .agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed")))


@query(with_tables("", "jobs", more={
    "r": "select channel_id, job_id, created_at, type, status = 'done' as last, row_number() over (partition by channel_id order by created_at, job_id) as rn from jobs"}) + """,
    walk as (select channel_id, rn, job_id, type as step, created_at as at0, true as keep from r where rn = 1 union all
      select r.channel_id, r.rn, r.job_id, case when r.last or r.type <> w.step or r.created_at - w.at0 >= 60000 then r.type else w.step end,
        case when r.last or r.type <> w.step or r.created_at - w.at0 >= 60000 then r.created_at else w.at0 end,
        r.last or r.type <> w.step or r.created_at - w.at0 >= 60000 from walk w join r on r.channel_id = w.channel_id and r.rn = w.rn + 1)
    select channel_id, job_id from walk where keep""")
def throttled_progress(spark, folder):
    """A change of step always keeps an event, so the steps cut a channel into separate runs."""
    j = jobs(spark, folder).select("channel_id", "job_id", "created_at", "type", F.when(F.col("status") == "done", 1.0).otherwise(0.5).alias("fraction"))
    chunk = F.floor(F.col("created_at") / 86_400)
    prev = scan(j, ["channel_id"], ["created_at", "job_id"], chunk, prev=last_value(F.col("type"), False))
    runs = scan(prev.withColumn("turn", (F.col("prev").isNull() | (F.col("prev") != F.col("type"))).cast("long")), ["channel_id"],
                ["created_at", "job_id"], chunk, run=running_sum(F.col("turn")))
    kept = fold_runs(runs, ["channel_id", "run"], ["created_at", "job_id"], ["created_at", "type", "fraction"], dict,
                     lambda st, at, step, f: bool(throttle(st, at, step, f, 60_000)), "keep", T.BooleanType())
    return kept.filter("keep").select("channel_id", "job_id")


@query(with_tables("""select channel_id, ledger_id from (select channel_id, ledger_id, channel_id % 4 as daily, row_number() over (partition by channel_id, taken_at // 86400 order by taken_at, ledger_id) as rn from ledger)
    where daily < 2 or rn <= daily""", "ledger"))
def daily_quota(spark, folder):
    led = ledger(spark, folder).select("channel_id", "ledger_id", "taken_at", local_day(F.col("taken_at")).alias("day"))
    turns = scan(led, ["channel_id", "day"], ["taken_at", "ledger_id"], F.floor(F.col("taken_at") / 86_400), rn=row_number())
    daily = F.col("channel_id") % 4
    return turns.filter((daily < 2) | (F.col("rn") <= daily)).select("channel_id", "ledger_id")


@query(with_tables("""select channel_id, file_hash, ledger_id from (select *, lag(status) over (partition by channel_id, file_hash order by ledger_id) as prev from ledger where status in ('taken','error'))
    where prev is null or prev = 'error'""", "ledger"))
def accepted_takes(spark, folder):
    """A hash is taken again only after an error: look at the entry before."""
    led = ledger(spark, folder).filter("status in ('taken', 'error')").select("channel_id", "file_hash", "ledger_id", "status")
    seen = scan(led, ["channel_id", "file_hash"], ["ledger_id"], F.floor(F.col("ledger_id") / 10_000_000), prev=last_value(F.col("status"), False))
    return seen.filter("prev is null or prev = 'error'").select("channel_id", "file_hash", "ledger_id")
