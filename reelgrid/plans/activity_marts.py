"""Activity marts over jobs, clips, channels and the intake ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import clock, errors
from reelgrid.operators import ledgers as lg, marts as mt
from reelgrid.operators.intervals import top_per_key
from reelgrid.operators.scan import row_number, scan
from reelgrid.plans.registry import query
from reelgrid.sources.standins import calls, channels, jobs, ledger, listing, segments, votes, with_tables
from reelgrid.sources.tables import read_table

NOW, TZ, OFF = 1_706_745_600 - 7200, "Asia/Ho_Chi_Minh", 25_200      # 2024-01-31 22:00 UTC
LEDGER_NOW = 915_148_800                                             # 1999-01-01
MID = (NOW + OFF) // 86_400 * 86_400 - OFF
LMID = (LEDGER_NOW + OFF) // 86_400 * 86_400 - OFF

# a supplier is a channel, an order in it a video
_CLIPS = {"clips": """select video_id as channel_id, order_id * 10000 + video_id as video_id, clip_id, s_ms, e_ms, score, status,
     score % 3 = 0 as llm_used from segments"""}


VIDEO = ["order_id", "channel_id"]      # what tells videos apart


def clips(spark, folder):
    return segments(spark, folder).select(
        "order_id", F.col("video_id").alias("channel_id"), (F.col("order_id") * 10_000 + F.col("video_id")).alias("video_id"),
        "clip_id", "s_ms", "e_ms", "score", "status", (F.col("score") % 3 == 0).alias("llm_used"))


@query(with_tables(f"""select count_if(status = 'running' and type <> 'export') as analyzing, count_if(status = 'running' and type = 'export') as exporting,
    count_if(status = 'pending') as waiting, count_if(status = 'pending' and type <> 'export') as waiting_analyze,
    count_if(status = 'pending' and type = 'export') as waiting_export, count_if(status = 'done' and created_at >= {MID}) as done,
    count_if(status = 'failed' and created_at >= {MID}) as failed from jobs""", "jobs"))
def queue_counts(spark, folder):
    return mt.queue_counts(jobs(spark, folder), NOW, TZ)


_FACTS = f"""count_if(status = 'running') as running, count_if(status = 'pending') as pending,
   count_if(status = 'failed' and coalesce(finished_at, created_at) >= {NOW - 86400}) as failed_24h,
   count_if(status = 'running' and type = 'export') as run_export"""
_ACT = _CLIPS | {
    "jf": f"select channel_id, {_FACTS} from jobs group by 1",
    "cf": "select channel_id, count(*) as clips, count_if(status = 'exported') as exported from clips where status <> 'archived' group by 1",
    "vf": "select channel_id, count(distinct video_id) as videos from clips group by 1",
    "ld": "select channel_id, max(finished_at) as last_done_at, arg_max(type, finished_at * 100000000 + job_id) as last_done_type from jobs where status = 'done' group by 1",
    "act": """select c.channel_id, c.name, c.grp, coalesce(running, 0) as running, coalesce(pending, 0) as pending, coalesce(failed_24h, 0) as failed_24h,
      coalesce(run_export, 0) as run_export, coalesce(clips, 0) as clips, coalesce(exported, 0) as exported, coalesce(videos, 0) as videos, last_done_at, last_done_type
      from channels c left join jf using (channel_id) left join cf using (channel_id) left join vf using (channel_id) left join ld using (channel_id)"""}


@query(with_tables("select * from act", "jobs", "channels", "segments", more=_ACT))
def channel_activity(spark, folder):
    c, j = clips(spark, folder), jobs(spark, folder)
    n_videos = c.groupBy("channel_id").agg(F.count_distinct("video_id").alias("videos"))
    base = channels(spark, folder).select("channel_id", "name", "grp")
    return (mt.with_facts(base, "channel_id", mt.job_facts(j, "channel_id", NOW), mt.clip_facts(c, "channel_id"), n_videos)
            .join(lg.last_done(j, "channel_id"), "channel_id", "left"))


@query(with_tables(f"""select video_id, {_FACTS}, max(case when status = 'done' then finished_at end) as last_done_at from jobs group by 1""", "jobs"))
def video_activity(spark, folder):
    j = jobs(spark, folder)
    done = j.groupBy("video_id").agg(F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("last_done_at"))
    return mt.job_facts(j, "video_id", NOW).join(done, "video_id")


_PREFIX = "coalesce(try_cast(nullif(regexp_extract(note, '^\\s*([+-]?\\d+)', 1), '') as bigint), 0)"
_PERIODS = {"today": ("0", "true"), "yesterday": ("86400", f"done_at < {LMID}"), "7d": (str(6 * 86400), "true"), "30d": (str(29 * 86400), "true")}
_PSTATS = {"ps": "select channel_id, " + ", ".join(
    f"count_if(i_{n} and status = 'done') as done_{n}, cast(coalesce(sum(case when i_{n} and status = 'done' then parts end), 0) as bigint) as parts_{n}, "
    f"count_if(i_{n} and status = 'error') as errors_{n}" for n in _PERIODS) + " from (select *, " + _PREFIX + " as parts, "
    + ", ".join(f"coalesce(done_at >= {LMID} - {low} and {extra}, false) as i_{n}" for n, (low, extra) in _PERIODS.items())
    + f" from ledger where done_at >= {LMID} - {29 * 86400}) group by 1"}


@query(with_tables("select * from ps", "ledger", more=_PSTATS))
def channel_period_stats(spark, folder):
    return mt.period_stats(ledger(spark, folder), LEDGER_NOW, TZ)


@query(with_tables(f"select channel_id, count(*) as done, cast(sum({_PREFIX}) as bigint) as parts from ledger where status = 'done' group by 1", "ledger"))
def lifetime_totals(spark, folder):
    return ledger(spark, folder).filter("status = 'done'").groupBy("channel_id").agg(
        F.count("*").alias("done"), F.sum(clock.leading_int(F.col("note"))).alias("parts"))


@query(with_tables(f"""select (taken_at + {OFF}) // 86400 as day, count_if(status = 'done') as done, count_if(status = 'error') as error,
    count_if(status = 'taken') as taken from ledger group by 1""", "ledger"))
def daily_mix(spark, folder):
    day = F.datediff(clock.local_day(F.col("taken_at"), TZ), F.lit("1970-01-01").cast("date")).cast("long")
    s = F.col("status")
    return ledger(spark, folder).groupBy(day.alias("day")).agg(
        *[F.count_if(s == x).alias(x) for x in ("done", "error", "taken")])


@query(with_tables("select grp, count(*) as n from channels where pipe_on and not pipe_hidden and grp <> '' group by 1", "channels"))
def group_counts(spark, folder):
    return (channels(spark, folder).filter("pipe_on and not pipe_hidden and grp <> ''").groupBy("grp")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "grp"))


@query(with_tables("select distinct grp from channels where trim(grp) <> ''", "channels"))
def list_groups(spark, folder):
    return channels(spark, folder).filter(F.trim("grp") != "").select("grp").distinct().orderBy("grp")


_BASIC = _CLIPS | {"basic": "select channel_id, video_id, count(*) as n_clips from clips where status <> 'archived' group by all having not bool_or(llm_used)"}


@query(with_tables("select * from basic", "segments", more=_BASIC))
def basic_cut_videos(spark, folder):
    return mt.basic_cut_videos(clips(spark, folder))


@query(with_tables("""select channel_id, count(*) as videos, count_if(ai) as by_model, count_if(not ai) as basic, cast(sum(parts) as bigint) as parts,
    cast(sum(ms) as bigint) as total_ms from (select channel_id, video_id, bool_or(llm_used) as ai, count(*) as parts, sum(e_ms - s_ms) as ms
    from clips where status <> 'archived' group by all) group by 1""", "segments", more=_CLIPS))
def outcome_summary(spark, folder):
    per = (clips(spark, folder).filter("status <> 'archived'").groupBy("channel_id", "video_id")
           .agg(F.bool_or("llm_used").alias("ai"), F.count("*").alias("parts"), F.sum(F.col("e_ms") - F.col("s_ms")).alias("ms")))
    return per.groupBy("channel_id").agg(F.count("*").alias("videos"), F.count_if("ai").alias("by_model"),
                                         F.count_if(~F.col("ai")).alias("basic"), F.sum("parts").alias("parts"), F.sum("ms").alias("total_ms"))


_INTAKE = {"it": f"""select channel_id, count_if(status in ('taken','done','error') and taken_at >= {LMID} and taken_at < {LMID + 86400}) as taken_today,
    max(case when status in ('taken','done') then taken_at end) as last_intake from ledger group by 1"""}


@query(with_tables("select * from it", "ledger", more=_INTAKE))
def intake_today(spark, folder):
    return mt.intake_today(ledger(spark, folder), LEDGER_NOW, TZ)


@query(with_tables(f"""select channel_id, ({LEDGER_NOW} + {OFF}) // 86400 - last_intake // 86400 as days from it
    where last_intake is not null and ({LEDGER_NOW} + {OFF}) // 86400 - last_intake // 86400 >= 3""", "ledger", more=_INTAKE))
def dry_sources(spark, folder):
    return mt.dry_sources(ledger(spark, folder), LEDGER_NOW, TZ)


@query(with_tables(f"""select type, count(*) as n, max(w) as longest, count_if(w > 600) as over_10min, quantile_cont(w, 0.5) as median,
    (list(w order by w))[least(count(*) - 1, count(*) * 95 // 100) + 1] as p95 from (select type, coalesce(started_at, {NOW}) - created_at as w from jobs) group by 1""", "jobs"))
def job_wait_stats(spark, folder):
    return mt.wait_stats(jobs(spark, folder), NOW)


@query(with_tables("""select day, model, calls, tok_in, tok_out, round(tok_in / 1e6 * p_in + tok_out / 1e6 * p_out, 6) as cost from (
    select calls.at // 86400 as day, model, count(*) as calls, cast(sum(tok_in) as bigint) as tok_in, cast(sum(tok_out) as bigint) as tok_out from calls group by all)
    join (select 'model' || s_suppkey as model, s_acctbal / 100 as p_in, s_acctbal / 50 as p_out from supplier) using (model)""", "calls"))
def usage_cost(spark, folder):
    prices = read_table(spark, folder, "supplier").filter("s_suppkey < 3").select(
        F.concat(F.lit("model"), F.col("s_suppkey").cast("string")).alias("model"),
        (F.col("s_acctbal") / 100).alias("p_in"), (F.col("s_acctbal") / 50).alias("p_out"))
    out = mt.usage_cost(calls(spark, folder), prices, [F.floor(F.col("at") / 86_400).alias("day")])
    return out.select("day", "model", "calls", "tok_in", "tok_out", F.round("cost", 6).alias("cost"))


_LEVELS = {"lv": """select p_partkey as asset_id, p_type as category, -(p_retailprice % 40) as mean_db, -(p_retailprice % 7) as peak_db,
     case when p_size % 2 = 0 then 3.0 else 0.0 end as category_db from part"""}


@query(with_tables("""select asset_id, round(gain, 4) as gain_db, round(pow(10.0, gain / 20), 4) as factor from (select asset_id,
    greatest(-30.0, least(15.0, least(-20.0 - 2.0 + category_db - mean_db, -1.0 - peak_db))) as gain from lv)""", more=_LEVELS))
def level_gains(spark, folder):
    return mt.level_gains(_levels(spark, folder)).select("asset_id", F.round("gain_db", 4).alias("gain_db"), F.round("factor", 4).alias("factor"))


def _levels(spark, folder):
    price = F.col("p_retailprice")
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("asset_id"), F.col("p_type").alias("category"), (-(price % 40)).alias("mean_db"),
        (-(price % 7)).alias("peak_db"), F.when(F.col("p_size") % 2 == 0, 3.0).otherwise(0.0).alias("category_db"))


@query(with_tables("""select category, count(*) as n, round(min(mean_db), 4) as lowest, round(max(mean_db), 4) as highest,
    round(max(mean_db) - min(mean_db), 4) as spread from lv group by 1""", more=_LEVELS))
def level_table_stats(spark, folder):
    return _levels(spark, folder).groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.min("mean_db"), 4).alias("lowest"), F.round(F.max("mean_db"), 4).alias("highest"),
        F.round(F.max("mean_db") - F.min("mean_db"), 4).alias("spread"))


_STEPS = {"st": """select channel_id as video_id, type || (priority % 2) as kind, status from jobs"""}


@query(with_tables("""select video_id, case when bool_or(status = 'running') then 'running' when bool_or(status = 'failed') then 'failed'
    when count(distinct case when status in ('done','skipped') then kind end) >= 5 then 'complete' else 'incomplete' end as label from
    (select *, row_number() over (partition by video_id, kind order by job_id desc) as rn from (select *, channel_id as vid from (select job_id, channel_id, channel_id as video_id, type || (priority % 2) as kind, status from jobs)))
    where rn = 1 group by 1""", "jobs"))
def analysis_labels(spark, folder):
    j = jobs(spark, folder).select("job_id", F.col("channel_id").alias("video_id"),
                                   F.concat("type", (F.col("priority") % 2).cast("string")).alias("kind"), "status")
    newest = j.groupBy("video_id", "kind").agg(F.max_by("status", "job_id").alias("status"))
    return mt.analysis_label(newest)


@query(with_tables("""select order_id, channel_id, cast(a.bytes as bigint) as bytes from a join c using (order_id, channel_id) where newest <= 3500000000 - 30 * 86400 and not open
    and not exists (select 1 from part where '/src/' || p_partkey = a.src and p_size > 20)""", "segments", more={
    "a": "select l_orderkey as order_id, l_suppkey as channel_id, '/src/' || (l_partkey % 500) as src, sum(cast(round(l_extendedprice) as bigint)) as bytes from lineitem group by all",
    "c": "select order_id, video_id as channel_id, max(s_ms) as newest, bool_or(status = 'suggested') as open from segments group by 1, 2"}))
def retention_candidates(spark, folder):
    a = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("channel_id"),
        F.concat(F.lit("/src/"), (F.col("l_partkey") % 500).cast("string")).alias("src"), F.round("l_extendedprice").cast("long").alias("bytes"))
    c = clips(spark, folder).withColumn("created_at", F.col("s_ms"))
    there = read_table(spark, folder, "part").filter("p_size > 20").select(F.concat(F.lit("/src/"), F.col("p_partkey").cast("string")).alias("path"))
    return mt.retention_candidates(a, c, there, 3_500_000_000, 30, VIDEO).select(*VIDEO, "bytes")


@query(with_tables("""select channel_id, name, grp, running, failed_24h, coalesce(done_30d, 0) as done, coalesce(errors_30d, 0) as errors, coalesce(parts_30d, 0) as parts
    from act left join ps using (channel_id) where coalesce(done_30d, 0) > 0 or coalesce(errors_30d, 0) > 0
    union all select null, 'all', grp, cast(sum(running) as bigint), cast(sum(failed_24h) as bigint), cast(sum(coalesce(done_30d, 0)) as bigint), cast(sum(coalesce(errors_30d, 0)) as bigint), cast(sum(coalesce(parts_30d, 0)) as bigint)
    from act left join ps using (channel_id) where coalesce(done_30d, 0) > 0 or coalesce(errors_30d, 0) > 0 group by rollup(grp)""",
                   "jobs", "channels", "segments", "ledger", more=_ACT | _PSTATS))
def channel_board(spark, folder):
    stats = channel_period_stats(spark, folder).select("channel_id", F.col("done_30d").alias("done"),
                                                       F.col("errors_30d").alias("errors"), F.col("parts_30d").alias("parts"))
    board = (mt.with_facts(channel_activity(spark, folder), "channel_id", stats).filter("done > 0 or errors > 0")
             .select("channel_id", "name", "grp", "running", "failed_24h", "done", "errors", "parts"))
    lines = board.rollup("grp").agg(*[F.sum(c).alias(c) for c in ("running", "failed_24h", "done", "errors", "parts")])
    return board.unionByName(lines.withColumn("channel_id", F.lit(None).cast("long")).withColumn("name", F.lit("all")))


@query(with_tables("""select order_id, channel_id, coalesce(runs, 0) as runs from (select order_id, channel_id from (select order_id, video_id as channel_id, score % 3 = 0 as llm_used,
      row_number() over (partition by order_id, video_id order by clip_id desc) as rn from segments where status = 'suggested') where rn <= 5 group by 1, 2 having not bool_or(llm_used))
    left join (select job_id as order_id, channel_id, count(*) as runs from jobs where type <> 'export' group by 1, 2) using (order_id, channel_id) where coalesce(runs, 0) < 2""",
                   "segments", "jobs"))
def reanalysis_due(spark, folder):
    j = jobs(spark, folder).select(F.col("job_id").alias("order_id"), "channel_id", "type")
    return mt.reanalysis_due(clips(spark, folder), j, key=VIDEO).select(*VIDEO, "runs")


@query(with_tables("select distinct video_id from jobs where status in ('pending','running')", "jobs"))
def busy_videos(spark, folder):
    return jobs(spark, folder).filter(F.col("status").isin("pending", "running")).select("video_id").distinct()


@query(with_tables("""select video_id, coalesce(max(case when status = 'running' then job_id end), min(case when status = 'pending' then job_id end)) as job_id,
    (select count(*) from jobs where status in ('running','pending')) - count(*) as others from jobs where status in ('running','pending') group by 1""", "jobs"))
def current_job(spark, folder):
    return mt.current_job(jobs(spark, folder))


@query(with_tables("""select x.at // 86400 as day, channel_id, cls, count(*) as n, cast(max(wait) as double) as longest_wait from (
    select created_at as at, channel_id, case when error like '%401%' then 'auth' when error like '%restricted%' then 'restricted'
     when error like '%413%' then 'too_large' when error like '%per day%' then 'day' when error like '%in 12s%' then 'minute'
     when error like '%retry-after%' then 'minute' when error like '%unavailable%' then 'transient' else 'other' end as cls,
     case when error like '%7m30.5s%' then 450.5 when error like '%in 12s%' then 12.0 when error like '%retry-after%' then 45.0 end as wait
    from jobs where status = 'failed') x group by all""", "jobs"))
def error_classes(spark, folder):
    e = jobs(spark, folder).filter("status = 'failed'")
    return e.groupBy(F.floor(F.col("created_at") / 86_400).alias("day"), "channel_id", errors.error_class(F.col("error")).alias("cls")).agg(
        F.count("*").alias("n"), F.max(errors.retry_wait_s(F.col("error"))).alias("longest_wait"))


@query(with_tables(f"""select key_id, state, case when state = 'limited' then until end as until from (
    select key_id, case when cls = 'auth' then 'invalid' when until > {NOW - 3600} then 'limited' else 'ready' end as state, until from (
    select key_id, cls, case when cls in ('day','minute') then "at" + case cls when 'day' then 451 else 12 end end as until from (
    select key_id, "at", case when error is null then null when error like '%401%' then 'auth' when error like '%per day%' then 'day' when error like '%in 12s%' then 'minute' else 'transient' end as cls
    from (select *, row_number() over (partition by key_id order by calls.at desc, call_id desc) as rn from calls) where rn = 1)))""", "calls"))
def key_health(spark, folder):
    return mt.key_health(calls(spark, folder), NOW - 3600)


@query(with_tables(f"""select job_id, case when created_at is null then '' when {NOW} - created_at < 90 then 'just now' when {NOW} - created_at < 3600 then (({NOW} - created_at) // 60) || ' min'
    when {NOW} - created_at < 86400 then (({NOW} - created_at) // 3600) || ' h' when {NOW} - created_at < 172800 then 'yesterday'
    else (({NOW} - created_at) // 86400) || ' days' end as age from jobs where created_at <= {NOW}""", "jobs"))
def relative_times(spark, folder):
    return jobs(spark, folder).select("job_id", clock.relative_time(F.col("created_at"), NOW).alias("age"))


# ---- joins ----
@query(with_tables("select j.job_id, j.status, c.name, v.src from jobs j left join channels c using (channel_id) left join (select o_orderkey as video_id, 'src ' || o_custkey as src from orders) v using (video_id)",
                   "jobs", "channels"))
def jobs_enriched(spark, folder):
    v = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("video_id"), F.concat(F.lit("src "), F.col("o_custkey").cast("string")).alias("src"))
    return (jobs(spark, folder).join(channels(spark, folder).select("channel_id", "name"), "channel_id", "left")
            .join(v, "video_id", "left").select("job_id", "status", "name", "src"))


@query(with_tables("select s.clip_id, s.score, o.o_orderstatus as video_state, c.name from segments s join orders o on o.o_orderkey = s.order_id join channels c on c.channel_id = o.o_custkey",
                   "segments", "channels"))
def clips_enriched(spark, folder):
    o = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("channel_id"), F.col("o_orderstatus").alias("video_state"))
    return (segments(spark, folder).select("clip_id", "order_id", "score").join(o, "order_id")
            .join(channels(spark, folder).select("channel_id", "name"), "channel_id").select("clip_id", "score", "video_state", "name"))


@query(with_tables("""select ledger_id, channel_id, video_id from ledger l where status = 'taken'
    and exists (select 1 from segments s where s.order_id = l.video_id and s.status = 'suggested')
    and not exists (select 1 from jobs j where j.video_id = l.video_id and j.status in ('pending','running'))
    and not exists (select 1 from jobs j where j.video_id = l.video_id and j.type = 'export' and j.status in ('canceled','skipped'))""", "ledger", "segments", "jobs"))
def stranded_videos(spark, folder):
    c = segments(spark, folder).select(F.col("order_id").alias("video_id"), "status")
    return lg.stranded_videos(ledger(spark, folder), c, jobs(spark, folder))


@query(with_tables("""select l.file_id, m.file_name as old_name, m.taken_at as old_at, m.ledger_id as old_id from listing l left join (
    select * from (select *, row_number() over (partition by channel_id, file_hash order by ledger_id desc) as rn from ledger where status in ('taken','done')) where rn = 1) m
    using (channel_id, file_hash)""", "listing", "ledger"))
def seen_before(spark, folder):
    files = listing(spark, folder).select("file_id", "channel_id", "file_hash")
    return lg.seen_before(files, ledger(spark, folder)).select("file_id", "old_name", "old_at", "old_id")


@query(with_tables("""select ledger_id, case when e = 'done' then 'close' when a is null and e is null and there is null then 'unmark'
    when coalesce(e in ('canceled','skipped'), false) or coalesce(a in ('canceled','skipped'), false) then 'cancel'
    when coalesce(e in ('pending','running'), false) or coalesce(a in ('pending','running'), false) then 'follow' else 'requeue' end as action from (
    select l.ledger_id, (select arg_max(j.status, j.job_id) from jobs j where j.video_id = l.video_id and j.type in ('analyze','auto')) as a,
      (select arg_max(j.status, j.job_id) from jobs j where j.video_id = l.video_id and j.type = 'export') as e,
      case when l.video_id in (select l_orderkey from lineitem) then true end as there from ledger l where l.status = 'taken')""", "ledger", "jobs"))
def resume_plan(spark, folder):
    led = ledger(spark, folder)
    files = read_table(spark, folder, "lineitem").select("l_orderkey").distinct()      # every order with a line has its file
    names = files.select(F.concat(F.lit("file "), F.col("l_orderkey").cast("string"), F.lit(".mp4")).alias("file_name"))
    return lg.resume_plan(led, jobs(spark, folder), names)


@query(with_tables("select lower(name) as name, arg_max(path, mtime * 10000 + length(path) * 0 + hash_rank) as path, max(mtime) as mtime from (select *, row_number() over (partition by lower(name), mtime order by path) as hash_rank from listing) group by 1", "listing"))
def recycled_index(spark, folder):
    return (listing(spark, folder).groupBy(F.lower("name").alias("name"))
            .agg(F.max_by("path", F.struct("mtime", "path")).alias("path"), F.max("mtime").alias("mtime")))


_PRESETS = "select 'Fast cut' as tpl, 'm1' as module, 7 as preset_id union all select 'Story', 'm1', 8 union all select 'gone', 'm2', 9"


@query(with_tables("""select c.channel_id, p.preset_id from channels c left join (select trim(r_name) as tpl, cast(r_regionkey as bigint) as preset_id from region
     union all select trim(tpl), max(cast(nation_id as bigint)) + 100 from (select distinct tpl_name as tpl, 0 as nation_id from channels where tpl_name <> 'gone') group by 1) p on trim(c.tpl_name) = p.tpl""", "channels"))
def template_for_channel(spark, folder):
    ch = channels(spark, folder)
    presets = (read_table(spark, folder, "region").select(F.trim("r_name").alias("tpl"), F.col("r_regionkey").cast("long").alias("preset_id"))
               .unionByName(ch.filter("tpl_name <> 'gone'").select(F.trim("tpl_name").alias("tpl"), F.lit(100).cast("long").alias("preset_id")).distinct()))
    return ch.withColumn("tpl", F.trim("tpl_name")).join(presets, "tpl", "left").select("channel_id", "preset_id")


@query(with_tables("select channel_id, grp, name from channels where trim(coalesce(tpl_name, '')) <> '' and trim(tpl_name) <> 'Fast cut'", "channels"))
def channels_on_other_template(spark, folder):
    t = F.trim("tpl_name")
    return channels(spark, folder).filter((t != "") & (t != "Fast cut")).select("channel_id", "grp", "name").orderBy("grp", "name")


@query(with_tables("""select v.channel, v.vote, v.clip_id, substr(regexp_replace(d.text, '\\s+', ' ', 'g'), 1, 180) as speech, d.n_chars * 60 as len_ms
    from votes v join documents d on d.doc_id = v.clip_id""", "votes"))
def vote_context(spark, folder):
    d = read_table(spark, folder, "documents").select(F.col("doc_id").alias("clip_id"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 180).alias("speech"),
                                                      (F.col("n_chars") * 60).alias("len_ms"))
    return votes(spark, folder).join(d, "clip_id").select("channel", "vote", "clip_id", "speech", "len_ms")


@query(with_tables("select channel, vote, vote_id, rank from (select *, row_number() over (partition by channel, vote order by vote_id desc) as rank from votes) where rank <= 6", "votes"))
def recent_votes(spark, folder):
    return top_per_key(votes(spark, folder), ["channel", "vote"], [F.col("vote_id").desc()], 6).select("channel", "vote", "vote_id", "rank")


@query(with_tables("select clip_id, video_id, row_number() over (partition by video_id order by s_ms, clip_id) as part from segments where status <> 'archived'", "segments"))
def part_numbers(spark, folder):
    live = segments(spark, folder).filter("status <> 'archived'").select("clip_id", "video_id", "s_ms")
    return scan(live, ["video_id"], ["s_ms", "clip_id"], F.floor(F.col("s_ms") / 600_000), part=row_number()).select("clip_id", "video_id", "part")


@query(with_tables("select video_id, max(job_id) as job_id, arg_max(status, job_id) as status, arg_max(type, job_id) as type from jobs where type in ('analyze','auto') group by 1", "jobs"))
def latest_job_per_video(spark, folder):
    j = jobs(spark, folder).filter(F.col("type").isin("analyze", "auto"))
    return j.groupBy("video_id").agg(F.max("job_id").alias("job_id"), F.max_by("status", "job_id").alias("status"), F.max_by("type", "job_id").alias("type"))


@query(with_tables("""select r.channel_id, case when nullif(trim(own), '') is not null then own when nullif(trim(save), '') is not null then save else '/root/' || name end as folder,
    case when nullif(trim(own), '') is null and nullif(trim(save), '') is null then 'default' else '' end as note, d.channel_id is not null as there
    from (select channel_id, name, case when channel_id % 3 = 0 then '/own/' || channel_id when channel_id % 3 = 1 then '  ' end as own, case when channel_id % 2 = 0 then '/save/' || channel_id end as save from channels) r
    left join (select distinct channel_id from listing) d using (channel_id)""", "channels", "listing"))
def source_folders(spark, folder):
    k = F.col("channel_id")
    own = F.when(k % 3 == 0, F.concat(F.lit("/own/"), k.cast("string"))).when(k % 3 == 1, "  ")
    save = F.when(k % 2 == 0, F.concat(F.lit("/save/"), k.cast("string")))
    set_own, set_save = F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(save), F.lit(""))
    there = listing(spark, folder).select("channel_id").distinct().withColumn("seen", F.lit(True))
    return channels(spark, folder).join(there, "channel_id", "left").select(
        "channel_id", F.coalesce(set_own, set_save, F.concat(F.lit("/root/"), "name")).alias("folder"),
        F.when(set_own.isNull() & set_save.isNull(), "default").otherwise("").alias("note"), F.col("seen").isNotNull().alias("there"))
