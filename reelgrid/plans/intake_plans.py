"""Intake, clean-up and table rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import names
from reelgrid.functions.fixed_values import CLAIM_EXPIRED
from reelgrid.operators import ledgers as lg, marts as mt
from reelgrid.operators.intervals import top_per_key
from reelgrid.operators.scan import row_number, scan
from reelgrid.plans.activity_marts import LEDGER_NOW, TZ, _BASIC, _INTAKE, _CLIPS, clips, basic_cut_videos
from reelgrid.plans.registry import query
from reelgrid.sources.standins import channels, jobs, ledger, listing, segments, with_tables
from reelgrid.sources.tables import cue_lines, latest_first, upsert_by_key

NOW = 1_000_000_000
_EXT = "regexp_matches(lower(name), '\\.(mp4|mkv|mov|avi|webm|m4v)$')"
_TMP = "regexp_matches(lower(name), '\\.(part|ytdl|tmp|crdownload|aria2|frag)$|\\.f[0-9]+\\.[^.]*$')"
_STATE = f"""case when not {_EXT} then case when {_TMP} then 'tmp' else 'other' end when {_TMP} then 'tmp'
  when regexp_matches(lower(name), '^part\\s*[0-9]') then 'part' when size > 0 and {NOW} - mtime >= 30 then 'ready'
  when size = 0 and {NOW} - mtime >= 30 then 'zero_old' else 'busy' end"""
_FILES = {"files": f"select *, {_STATE} as state from listing"}


def files(spark, folder):
    return listing(spark, folder).withColumn("state", names.file_state(F.col("name"), F.col("size"), F.col("mtime"), NOW))


@query(with_tables("select file_id, state from files", "listing", more=_FILES))
def classify_listing(spark, folder):
    return files(spark, folder).select("file_id", "state")


@query(with_tables("select state, count(*) as files, cast(sum(size) as bigint) as bytes from files where state not in ('ready','other') group by 1", "listing", more=_FILES))
def storage_summary(spark, folder):
    return files(spark, folder).filter("state not in ('ready', 'other')").groupBy("state").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(with_tables("""select file_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '\\s*[-–]\\s*YouTube\\s*$', '', 'i'),
    '\\s*\\[[0-9a-zA-Z_-]{8,}\\]\\s*$', ''), '\\s*\\(?\\b(1080|720|2160|480)p\\b\\)?', '', 'gi'), '[\\s_]+', ' ', 'g')) as title,
    regexp_replace(name, '[\\\\/:*?"<>|]', '', 'g') as safe from listing""", "listing"))
def titles_from_files(spark, folder):
    return listing(spark, folder).select("file_id", names.title_from_file(F.col("name")).alias("title"), names.safe_name(F.col("name")).alias("safe"))


@query(with_tables("""select channel_id, name, grp from channels where contains(lower(name), '1') order by not starts_with(lower(name), '1'), grp, name, channel_id limit 300""", "channels"))
def search_channels(spark, folder):
    low = F.lower("name")
    return (channels(spark, folder).filter(low.contains("1"))
            .orderBy(~low.startswith("1"), "grp", "name", "channel_id").limit(300).select("channel_id", "name", "grp"))


@query(with_tables("select channel_id, grp, name from channels where pipe_on and not pipe_hidden and grp = 'BUILDING'", "channels"))
def runnable_channels(spark, folder):
    return (channels(spark, folder).filter("pipe_on and not pipe_hidden and grp = 'BUILDING'")
            .select("channel_id", "grp", "name").orderBy("grp", "name"))


@query(with_tables("select clip_id, video_id, s_ms from segments where status <> 'archived'", "segments"))
def list_clips(spark, folder):
    return (segments(spark, folder).filter("status <> 'archived'")
            .select("clip_id", "video_id", "s_ms").orderBy("video_id", "s_ms", "clip_id"))


@query(with_tables("select video_id, clip_id, rank from (select *, row_number() over (partition by video_id order by s_ms, clip_id) as rank from segments where status = 'suggested') where rank <= 5", "segments"))
def suggestion_cap(spark, folder):
    t = segments(spark, folder).filter("status = 'suggested'").select("video_id", "clip_id", "s_ms")
    return top_per_key(t, ["video_id"], [F.col("s_ms"), F.col("clip_id")], 5).select("video_id", "clip_id", "rank")


_ORD = "case status when 'running' then 0 when 'pending' then 1 else 2 end"


@query(with_tables(f"select job_id, status from jobs order by {_ORD}, job_id desc limit 200", "jobs"))
def list_jobs(spark, folder):
    turn = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).otherwise(2)
    return jobs(spark, folder).orderBy(turn, F.desc("job_id")).limit(200).select("job_id", "status")


@query(with_tables(f"""select * from (select job_id, status from jobs where status in ('running','pending') order by {_ORD}, job_id desc limit 24)
    union all select * from (select job_id, status from jobs where status not in ('running','pending') order by status <> 'failed', job_id desc limit 12)""", "jobs"))
def list_jobs_top(spark, folder):
    j = jobs(spark, folder).select("job_id", "status")
    act = F.col("status").isin("running", "pending")
    return (j.filter(act).orderBy(F.when(F.col("status") == "running", 0).otherwise(1), F.desc("job_id")).limit(24)
            .unionByName(j.filter(~act).orderBy(F.col("status") != "failed", F.desc("job_id")).limit(12)))


@query(with_tables("select type as lane, job_id, rank from (select *, row_number() over (partition by type order by priority desc, created_at, job_id) as rank from jobs where status = 'pending') where rank <= 50", "jobs"))
def lane_heads(spark, folder):
    j = jobs(spark, folder).filter("status = 'pending'").select(F.col("type").alias("lane"), "job_id", "priority", "created_at")
    return top_per_key(j, ["lane"], [F.desc("priority"), F.col("created_at"), F.col("job_id")], 50).select("lane", "job_id", "rank")


_NEW = _FILES | {
    "fresh": """select f.* from files f join channels c using (channel_id) where f.state = 'ready' and c.pipe_on and not c.pipe_hidden
       and not exists (select 1 from ledger l where l.channel_id = f.channel_id and l.file_hash = f.file_hash and l.status in ('taken','done'))"""}


@query(with_tables(f"""select channel_id, file_id, turn from (select f.channel_id, f.file_id, c.daily, coalesce(t.taken_today, 0) as used,
    row_number() over (partition by f.channel_id order by f.mtime, f.file_id) as turn from fresh f join channels c using (channel_id) left join it t using (channel_id))
    where daily < 2 or turn <= greatest(0, daily - used)""", "listing", "channels", "ledger", more=_NEW | _INTAKE))
def intake_plan(spark, folder):
    led = ledger(spark, folder)
    on = channels(spark, folder).filter("pipe_on and not pipe_hidden").select("channel_id", "daily")
    ready = files(spark, folder).filter("state = 'ready'").select("channel_id", "file_id", "file_hash", "mtime").join(on, "channel_id")
    fresh = lg.seen_before(ready, led).filter("old_id is null")
    used = mt.intake_today(led, LEDGER_NOW, TZ).select("channel_id", "taken_today")
    turns = scan(fresh.select("channel_id", "file_id", "mtime", "daily"), ["channel_id"], ["mtime", "file_id"],
                 F.floor(F.col("mtime") / (30 * 86_400)), turn=row_number()).join(used, "channel_id", "left")
    quota = F.greatest(F.lit(0), F.col("daily") - F.coalesce("taken_today", F.lit(0)))
    return turns.filter((F.col("daily") < 2) | (F.col("turn") <= quota)).select("channel_id", "file_id", "turn")


@query(with_tables("select channel_id, min(file_id) as file_id, lower(path) as lpath from (select * from files where state in ('ready','part') union all select * from files where state in ('part','zero_old')) group by channel_id, lower(path)", "listing", more=_FILES))
def union_dedup_paths(spark, folder):
    f = files(spark, folder)
    both = f.filter("state in ('ready', 'part')").unionByName(f.filter("state in ('part', 'zero_old')"))
    return both.groupBy("channel_id", F.lower("path").alias("lpath")).agg(F.min("file_id").alias("file_id"))


@query(with_tables("select distinct regexp_extract(path, '/([0-9]{4}-[0-9]{2}-[0-9]{2})/', 1) as day from listing", "listing"))
def recycled_days(spark, folder):
    return listing(spark, folder).select(F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/", 1).alias("day")).filter("day <> ''").distinct().orderBy(F.desc("day"))


@query(with_tables("""select state, count(*) as n from (select case when o.video_id % 7 = 0 then 'present' when r.name is not null then 'found' else 'lost' end as state
    from basic o left join (select distinct lower(name) as name from listing) r on r.name = 'part ' || (o.video_id % 9) || '.mp4') group by 1""", "segments", "listing", more=_BASIC))
def reanalysis_plan(spark, folder):
    v = basic_cut_videos(spark, folder).withColumn("name", F.concat(F.lit("part "), (F.col("video_id") % 9).cast("string"), F.lit(".mp4")))
    found = listing(spark, folder).select(F.lower("name").alias("name")).distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("video_id") % 7 == 0, "present").when(F.col("hit"), "found").otherwise("lost")
    return v.join(found, "name", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(with_tables("""select l.ledger_id, exists (select 1 from listing x where x.channel_id = l.channel_id and x.file_hash = l.file_hash) as still_there
    from ledger l where l.status = 'done' and contains(l.note, 'URGENT')""", "ledger", "listing"))
def cleanup_retry_candidates(spark, folder):
    there = listing(spark, folder).select("channel_id", "file_hash").distinct().withColumn("hit", F.lit(True))
    return (ledger(spark, folder).filter((F.col("status") == "done") & F.col("note").contains("URGENT"))
            .join(there, ["channel_id", "file_hash"], "left").select("ledger_id", F.col("hit").isNotNull().alias("still_there")))


@query(with_tables("""select ledger_id, case when parts > 0 and bad = 0 then 'done' else 'error' end as status,
    case when bad > 0 then 'export failed' when parts = 0 then 'no exported part' else parts || ' part' end as note from (
    select l.ledger_id, (select count(*) from segments s where s.order_id = l.video_id and s.status = 'exported') as parts,
      (select count(*) from jobs j where j.video_id = l.video_id and j.type = 'export' and j.status = 'failed') as bad from ledger l where l.status = 'taken')""", "ledger", "segments", "jobs"))
def finish_check(spark, folder):
    made = segments(spark, folder).filter("status = 'exported'").groupBy(F.col("order_id").alias("video_id")).agg(F.count("*").alias("parts"))
    bad = jobs(spark, folder).filter("type = 'export' and status = 'failed'").groupBy("video_id").agg(F.count("*").alias("bad"))
    rows = mt.with_facts(ledger(spark, folder).filter("status = 'taken'").select("ledger_id", "video_id"), "video_id", made, bad)
    ok = (F.col("parts") > 0) & (F.col("bad") == 0)
    note = (F.when(F.col("bad") > 0, "export failed").when(F.col("parts") == 0, "no exported part")
            .otherwise(F.concat(F.col("parts").cast("string"), F.lit(" part"))))
    return rows.select("ledger_id", F.when(ok, "done").otherwise("error").alias("status"), note.alias("note"))


@query(with_tables(f"""select ledger_id, case when stale then 'error' else status end as status, case when stale then coalesce(note, '') || '{CLAIM_EXPIRED}' else note end as note,
    case when stale then 900000000 else done_at end as done_at from (
    select *, status = 'taken' and taken_at < 900000000 - 43200 and not exists (select 1 from jobs j where j.video_id = ledger.video_id and j.status = 'running') as stale from ledger)""", "ledger", "jobs"))
def claim_expiry(spark, folder):
    busy = jobs(spark, folder).filter("status = 'running'").select("video_id")
    return lg.expire_claims(ledger(spark, folder), busy, 900_000_000).select("ledger_id", "status", "note", "done_at")


@query(with_tables("""select channel_id, file_hash, status, note, taken_at as at, n from (select *, row_number() over (partition by channel_id, file_hash order by taken_at desc, ledger_id desc) as rn,
    count(*) over (partition by channel_id, file_hash) as n from ledger) where rn = 1 and status <> 'bad'""", "ledger"))
def ledger_fold(spark, folder):
    e = ledger(spark, folder).select("channel_id", "file_hash", "note", F.col("taken_at").alias("at"), F.col("ledger_id").alias("event_id"),
                                     F.when(F.col("status") == "bad", "unmark").otherwise(F.col("status")).alias("status"))
    return lg.apply_ledger_events(e)


@query(with_tables("select job_id, case when status = 'running' then case when cancel_req then 'canceled' when attempts < 3 then 'pending' else 'failed' end else status end as status from jobs", "jobs"))
def job_reconcile(spark, folder):
    return lg.reconcile(jobs(spark, folder)).select("job_id", "status")


@query(with_tables("select channel_id, max(finished_at) as last_done_at, arg_max(type, finished_at * 100000000 + job_id) as last_done_type from jobs where status = 'done' group by 1", "jobs"))
def last_done_backfill(spark, folder):
    return lg.last_done(jobs(spark, folder), "channel_id")


@query(with_tables("""select r.job_id as request_id, r.video_id as dedup_key, case when coalesce(h.done, false) and r.attempts <> 3 then 'drop'
    when coalesce(h.active, false) or r.job_id > f.first_id then 'join' else 'new' end as action
    from (select * from jobs where job_id % 4 = 0) r left join (select video_id, bool_or(status = 'done') as done, bool_or(status in ('pending','running')) as active from jobs where job_id % 4 <> 0 group by 1) h using (video_id)
    join (select video_id, min(job_id) as first_id from jobs where job_id % 4 = 0 group by 1) f using (video_id)""", "jobs"))
def request_dedup(spark, folder):
    j = jobs(spark, folder)
    asked = j.filter("job_id % 4 = 0").select(F.col("job_id").alias("request_id"), F.col("video_id").alias("dedup_key"), (F.col("attempts") == 3).alias("force"))
    past = j.filter("job_id % 4 <> 0").select(F.col("video_id").alias("dedup_key"), "status")
    return lg.dedup_requests(asked, past)


@query(with_tables("""select clip_id, case when t and not w and status = 'exported' then 'archived' else status end as status from (
    select clip_id, status, order_id % 3 = 0 as t, coalesce(score > 90, false) as w from segments) where not (t and not w and status = 'suggested')""", "segments"))
def replace_suggestions(spark, folder):
    t = segments(spark, folder).select("clip_id", F.col("order_id").alias("video_id"), "status", "score")
    return lg.replace_suggestions(t, t.filter("video_id % 3 = 0"), t.filter("score > 90")).select("clip_id", "status")


@query(with_tables("""select f.file_id, coalesce(o.old_id, n.first_id) as video_id, o.old_id is null and f.file_id = n.first_id as is_new from listing f
    left join (select channel_id, file_hash, min(video_id) as old_id from ledger group by all) o using (channel_id, file_hash)
    join (select channel_id, file_hash, min(file_id) as first_id from listing group by all) n using (channel_id, file_hash)""", "listing", "ledger"))
def import_dedup(spark, folder):
    return lg.import_files(listing(spark, folder), ledger(spark, folder))


@query(with_tables("""select channel_id, coalesce(d.grp, b.grp) as grp, case when d.channel_id is null then b.name else d.name end as name from
    (select channel_id, grp, name from channels where channel_id % 5 <> 0) b full join (select channel_id, grp, name || '!' as name from channels where channel_id % 3 = 0 or channel_id % 5 = 0) d using (channel_id)""", "channels"))
def upsert_rows(spark, folder):
    c = channels(spark, folder)
    base = c.filter("channel_id % 5 <> 0").select("channel_id", "grp", "name", F.lit(1).alias("version"))
    delta = c.filter("channel_id % 3 = 0 or channel_id % 5 = 0").select("channel_id", "grp", F.concat("name", F.lit("!")).alias("name"), F.lit(2).alias("version"))
    return upsert_by_key(base, delta, ["channel_id"], "version").select("channel_id", "grp", "name")


@query(with_tables("""select channel_id, case when grp = 'BUILDING' then 'HOUSES' when grp = 'MACHINERY' then '' when trim(grp) = '' then 'default' else grp end as grp from channels""", "channels"))
def regroup_channels(spark, folder):
    g = F.col("grp")
    return channels(spark, folder).select("channel_id", F.when(g == "BUILDING", "HOUSES").when(g == "MACHINERY", "")
                                          .when(F.trim(g) == "", "default").otherwise(g).alias("grp"))


_RENAMES = {"ch": """select o_orderkey as channel_id, trim(case when o_orderkey % 7 = 0 then ' ' when o_orderkey % 5 = 0 then 'Customer#00000000' || (o_orderkey % 10)
    else 'New ' || (o_orderkey % 900) end) as new_name from orders"""}


@query(with_tables("""select x.channel_id, x.new_name, case when c.channel_id is null then 'unknown' when x.new_name = '' then 'blank'
    when exists (select 1 from channels h where h.name = x.new_name and h.channel_id <> x.channel_id) or x.channel_id > f.first_id then 'taken' else 'ok' end as result
    from ch x left join channels c using (channel_id) join (select new_name, min(channel_id) as first_id from ch group by 1) f using (new_name)""", "channels", more=_RENAMES))
def rename_results(spark, folder):
    from reelgrid.sources.tables import read_table
    k = F.col("o_orderkey")
    name = (F.when(k % 7 == 0, " ").when(k % 5 == 0, F.concat(F.lit("Customer#00000000"), (k % 10).cast("string")))
            .otherwise(F.concat(F.lit("New "), (k % 900).cast("string"))))
    asked = read_table(spark, folder, "orders").select(k.alias("channel_id"), name.alias("new_name"))
    return lg.rename_channels(channels(spark, folder), asked)


@query(with_tables("select ledger_id from ledger where channel_id not in (select channel_id from channels where nation_id = 3)", "ledger", "channels"))
def reset_channel(spark, folder):
    gone = channels(spark, folder).filter("nation_id = 3").select("channel_id")
    return lg.purge(ledger(spark, folder), gone, "channel_id").select("ledger_id")


@query(with_tables("""select 'clip' as kind, clip_id as id from clips where channel_id not in (select channel_id from channels where nation_id = 3)
    union all select 'file', file_id from listing where channel_id in (select channel_id from channels where nation_id = 3)""", "segments", "channels", "listing", more=_CLIPS))
def purge_cascade(spark, folder):
    gone = channels(spark, folder).filter("nation_id = 3").select("channel_id")
    kept = lg.purge(clips(spark, folder), gone, "channel_id").select(F.lit("clip").alias("kind"), F.col("clip_id").alias("id"))
    drop = listing(spark, folder).join(gone, "channel_id", "left_semi").select(F.lit("file").alias("kind"), F.col("file_id").alias("id"))
    return kept.unionByName(drop)


@query(with_tables("select job_id from jobs where status not in ('done','failed','canceled','skipped')", "jobs"))
def purge_finished_jobs(spark, folder):
    return jobs(spark, folder).filter(~F.col("status").isin("done", "failed", "canceled", "skipped")).select("job_id")


@query(with_tables("""select channel_id, case when channel_id % 6 = 0 then false else pipe_on end as pipe_on, case when channel_id % 6 = 0 then true else pipe_hidden end as pipe_hidden from channels""", "channels"))
def set_channel_flags(spark, folder):
    ch = channels(spark, folder)
    hide = ch.filter("channel_id % 6 = 0").select("channel_id", F.lit(True).alias("hide"))
    return ch.join(hide, "channel_id", "left").select(
        "channel_id", F.when(F.col("hide"), False).otherwise(F.col("pipe_on")).alias("pipe_on"),
        F.when(F.col("hide"), True).otherwise(F.col("pipe_hidden")).alias("pipe_hidden"))


@query(with_tables("select channel_id, file_id from (select *, row_number() over (partition by channel_id order by mtime desc, file_id desc) as rn from listing) where rn > 3", "listing"))
def keep_newest(spark, folder):
    f = listing(spark, folder).select("channel_id", "file_id", "mtime")
    return lg.keep_newest(f, ["channel_id"], ["mtime", "file_id"], F.floor(F.col("mtime") / (90 * 86_400)), 3).select("channel_id", "file_id")


@query(with_tables(f"select file_id from files where (state = 'tmp' and {NOW} - mtime > 86400) or (state in ('zero_old','part') and {NOW} - mtime > 604800)", "listing", more=_FILES))
def older_than(spark, folder):
    age = F.lit(NOW) - F.col("mtime")
    s = F.col("state")
    return files(spark, folder).filter(((s == "tmp") & (age > 86_400)) | (s.isin("zero_old", "part") & (age > 604_800))).select("file_id")


@query(with_tables("""select channel_id, file_id from (select *, sum(size) over (partition by channel_id) - coalesce(sum(size) over (partition by channel_id order by mtime, file_id
    rows between unbounded preceding and 1 preceding), 0) as left_over from listing) where left_over > 9000000""", "listing"))
def lru_evict(spark, folder):
    f = listing(spark, folder).select("channel_id", "file_id", "mtime", "size")
    return lg.evict_oldest(f, ["channel_id"], ["mtime", "file_id"], F.floor(F.col("mtime") / (90 * 86_400)), "size", 9_000_000).select("channel_id", "file_id")


@query(with_tables("""select order_id as clip_id, seg_idx as cue_no,
    printf('%d:%02d:%02d.%02d', ((s_ms+5)//10)//360000, (((s_ms+5)//10)//6000) % 60, (((s_ms+5)//10)//100) % 60, ((s_ms+5)//10) % 100) || ',' ||
    printf('%d:%02d:%02d.%02d', ((e_ms+5)//10)//360000, (((e_ms+5)//10)//6000) % 60, (((e_ms+5)//10)//100) % 60, ((e_ms+5)//10) % 100) || ',' || status as line from segments""", "segments"))
def cue_text_lines(spark, folder):
    t = segments(spark, folder).select(F.col("order_id").alias("clip_id"), F.col("seg_idx").alias("cue_no"), F.col("s_ms").alias("start_ms"), F.col("e_ms").alias("end_ms"), F.col("status").alias("text"))
    return cue_lines(t)
