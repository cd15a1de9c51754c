"""Islands, peaks and scores over the per-second signals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelgrid.functions import text as tx
from reelgrid.operators import joins as jn, signals as sg
from reelgrid.operators.intervals import top_per_key
from reelgrid.plans.interval_sets import scene_cuts, _CUTS
from reelgrid.plans.registry import query
from reelgrid.plans.sqltext import NORM, N_TOKENS, is_junk_sql
from reelgrid.sources.standins import segments, sentences, signal, with_tables

KEY = ["video_id"]
CHUNK = 3600

_LOUD = {
    "stat": "select video_id, sum(rms) as total, count(*) as n from signal group by 1",
    "hi": """select s.video_id, s.sec, s.rms, total, n, s.sec - row_number() over (partition by s.video_id order by s.sec) as g
       from signal s join stat using (video_id) where total > 0 and rms * n * 10 >= total * 16""",
    "loud": """select video_id, min(sec) as from_sec, max(sec) + 1 as to_sec,
       round((sum(rms) / count(*)) / (any_value(total) / any_value(n)), 2) as ratio from hi group by video_id, g""",
    "loud_top": "select * from (select *, row_number() over (partition by video_id order by ratio desc, from_sec) as rank from loud) where rank <= 12"}


@query(with_tables("select * from loud_top", "signal", more=_LOUD))
def loud_islands(spark, folder):
    return sg.loud_islands(signal(spark, folder), KEY, CHUNK)


_ACTION = {
    "stat2": "select video_id, sum(motion) as total, count(*) as n, list(motion order by motion) as xs from signal group by 1",
    "bars": """select video_id, total, n, xs[greatest(0, n * 20 // 100 - 1) + 1] as p20, xs[least(n - 1, n * 90 // 100) + 1] as p90 from stat2""",
    "spoken": "select distinct video_id, unnest(generate_series(start_ms // 1000, end_ms // 1000)) as sec from sentences",
    "live": """select s.video_id, s.sec, s.motion, total, n, s.sec - row_number() over (partition by s.video_id order by s.sec) as g
       from signal s join bars b using (video_id) where total > 0
       and case when p20 * 10 + greatest(0, p90 - p20) * 4 > 0 then motion * 10 >= p20 * 10 + greatest(0, p90 - p20) * 4 else motion * n >= total end
       and not exists (select 1 from spoken k where k.video_id = s.video_id and k.sec = s.sec)""",
    "action": """select video_id, min(sec) as from_sec, max(sec) + 1 as to_sec,
       round((sum(motion) / count(*)) / (any_value(total) / any_value(n)), 2) as ratio from live group by video_id, g having count(*) >= 2""",
    "action_top": "select * from (select *, row_number() over (partition by video_id order by ratio desc, from_sec) as rank from action) where rank <= 8"}


@query(with_tables("select * from action_top", "signal", "sentences", more=_ACTION))
def silent_action_islands(spark, folder):
    return sg.silent_action_islands(signal(spark, folder), sentences(spark, folder), KEY, CHUNK)


@query(with_tables("""select video_id, 'loud' as kind, from_sec, to_sec, ratio, rank from loud_top
    union all select video_id, 'action', from_sec, to_sec, ratio, rank from action_top""", "signal", "sentences", more=_LOUD | _ACTION))
def signal_evidence(spark, folder):
    loud, action = loud_islands(spark, folder), silent_action_islands(spark, folder)
    return loud.withColumn("kind", F.lit("loud")).unionByName(action.withColumn("kind", F.lit("action")))


@query(with_tables("""select video_id, min(sec) as from_sec, max(sec) + 1 as to_sec from (
    select s.video_id, sec, sec - row_number() over (partition by s.video_id order by sec) as g from signal s
    join (select video_id, max(rms) as peak from signal group by 1) using (video_id) where rms * 100 < peak * 10)
    group by video_id, g having count(*) >= 2""", "signal"))
def silence_islands(spark, folder):
    return sg.silence_islands(signal(spark, folder), KEY, CHUNK, percent=10, samples=2)


@query(with_tables("""select video_id, start_ms, end_ms from (
      select video_id, coalesce(max(b) over (partition by video_id order by a, b rows between unbounded preceding and 1 preceding), 0) as start_ms, a as end_ms
      from (select video_id, least(greatest(s_ms, 0), 4500000) as a, least(greatest(e_ms, 0), 4500000) as b from segments where status = 'exported')
      union all select video_id, max(least(greatest(e_ms, 0), 4500000)), 4500000 from segments where status = 'exported' group by 1)
    where end_ms - start_ms > 50 and end_ms - start_ms >= 120""", "segments"))
def speech_from_silence(spark, folder):
    quiet = segments(spark, folder).filter("status = 'exported'")
    return sg.speech_from_silence(quiet, KEY, "s_ms", "e_ms", 4_500_000, 600_000)


@query(with_tables("", "signal", more={
    "x": "select s.*, peak from signal s join (select video_id, max(rms) as peak from signal group by 1) using (video_id)",
    "y": """select *, max(rms) over (partition by video_id order by sec range between 20 preceding and 19 following) as top,
       sum(rms) over (partition by video_id order by sec range between 40 preceding and 39 following) as s,
       count(*) over (partition by video_id order by sec range between 40 preceding and 39 following) as c from x""",
    "r": "select video_id, sec, rms, row_number() over (partition by video_id order by sec) as rn from y where rms = top and rms * c * 20 >= s * 20 + peak * c * 3"}) + """,
    walk as (select video_id, rn, sec, rms, sec as last, true as keep from r where rn = 1 union all
      select r.video_id, r.rn, r.sec, r.rms, case when r.sec - w.last >= 11 then r.sec else w.last end, r.sec - w.last >= 11
      from walk w join r on r.video_id = w.video_id and r.rn = w.rn + 1)
    select video_id, sec, rms from walk where keep""")
def local_peaks(spark, folder):
    return sg.local_peaks(signal(spark, folder), KEY, CHUNK)


_MED = {"med": "select video_id, quantile_cont(rms, 0.5) as mr, quantile_cont(motion, 0.5) as mm, max(rms) as xr, max(motion) as xm, count(*) as n, max(sec) as last_sec from signal group by 1",
        "sur": """select video_id, sec, rms, motion, mr, mm, last_sec, rms / case when mr = 0 then 1e-6 else mr end + motion / case when mm = 0 then 1e-6 else mm end
      + 1.5 * greatest(0, (rms - coalesce(recent, 0)) / case when mr = 0 then 1e-6 else mr end) as score from (
      select s.*, mr, mm, last_sec, (select quantile_cont(p.rms, 0.5) from signal p where p.video_id = s.video_id and p.sec between s.sec - 3 and s.sec - 1) as recent
      from signal s join med using (video_id))"""}


@query(with_tables("select video_id, sec, round(score, 4) as score, rank from (select *, row_number() over (partition by video_id order by round(score, 4) desc, sec) as rank from sur)",
                   "signal", more=_MED))
def surprise_rank(spark, folder):
    scored = sg.surprise(signal(spark, folder), KEY, CHUNK).select(*KEY, "sec", F.round("score", 4).alias("score"))
    order = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "sec")
    return scored.withColumn("rank", F.row_number().over(order))


@query(with_tables("""select video_id, case when n < 3 or mr <= 0 then 0 else round(xr / mr, 4) end as rms_range,
    case when n < 3 or mm <= 0 then 0 else round(xm / mm, 4) end as motion_range from med""", "signal", more=_MED))
def dynamic_range(spark, folder):
    m = sg.medians(signal(spark, folder), KEY)
    def ratio(x, med):
        return F.when((F.col("n") < 3) | (F.col(med) <= 0), 0.0).otherwise(F.round(F.col(x) / F.col(med), 4))
    return m.select(*KEY, ratio("max_rms", "med_rms").alias("rms_range"), ratio("max_motion", "med_motion").alias("motion_range"))


@query(with_tables("""select video_id, sec, case when exists (select 1 from sentences j where j.video_id = q.video_id and abs(q.sec * 1000 - j.end_ms) <= 600) then 'join'
     when sec >= last_sec + 1 - 3 then 'close' when motion <= mm * 0.55 then 'still' when mr > 0 and rms >= mr * 1.7 then 'peak'
     when mm > 0 and motion >= mm * 1.5 then 'action' else 'plain' end as kind from sur q""", "signal", "sentences", more=_MED))
def moment_kinds(spark, folder):
    s = sg.surprise(signal(spark, folder), KEY, CHUNK)
    joins = (sentences(spark, folder).select(*KEY, F.explode(F.sequence(
        F.ceil((F.col("end_ms") - 600) / 1000), F.floor((F.col("end_ms") + 600) / 1000))).alias("sec"))
        .distinct().withColumn("at_join", F.lit(True)))
    kind = sg.moment_kind(F.col("rms"), F.col("motion"), F.col("med_rms"), F.col("med_motion"), F.col("sec"),
                          F.col("last_sec") + 1, F.coalesce("at_join", F.lit(False)))
    return s.join(joins, [*KEY, "sec"], "left").select(*KEY, "sec", kind.alias("kind"))


@query(with_tables("""select video_id, idx, start_sec as hook_sec, loud from (select *, row_number() over (partition by video_id, idx order by loud desc, start_sec) as rn from (
    select p.video_id, p.idx, p.start_sec, sum(s.rms) as loud from (select video_id, idx, unnest(generate_series(start_ms // 1000,
      greatest(start_ms // 1000, end_ms // 1000 - 3))) as start_sec from sentences) p
    join signal s on s.video_id = p.video_id and s.sec between p.start_sec and p.start_sec + 2 group by all having count(*) = 3)) where rn = 1""", "signal", "sentences"))
def loudest_hook(spark, folder):
    segs = sentences(spark, folder).select(*KEY, "idx", F.lit(0).alias("seg_idx"), F.col("start_ms").alias("s_ms"), F.col("end_ms").alias("e_ms"))
    return sg.loudest_hook(signal(spark, folder), segs, KEY, ["idx"], CHUNK)


_WIN = {"win": "select video_id, idx, start_ms // 1000 as a, end_ms // 1000 as b from sentences",
        "base": """select w.video_id, w.idx, w.a, w.b, sum(s.rms) as rs, count(s.rms) as rn, max(s.rms) as rx from win w
          left join signal s on s.video_id = w.video_id and s.sec >= w.a and s.sec < w.b group by all"""}


@query(with_tables("select video_id, idx, round(least(100, case when rn = 0 then 0 else (6 * rs / rn + 4 * rx) / 100 end), 4) as score from base",
                   "signal", "sentences", more=_WIN))
def audio_scores(spark, folder):
    win = sentences(spark, folder).select(*KEY, "idx", F.floor(F.col("start_ms") / 1000).alias("a"), F.floor(F.col("end_ms") / 1000).alias("b"))
    base = sg.audio_base(signal(spark, folder), win, KEY, ["idx"], "a", "b", 60)
    score = F.coalesce((6 * F.col("rms_sum") / F.col("rms_n") + 4 * F.col("rms_max")) / 100, F.lit(0.0))
    return win.join(base, [*KEY, "idx"], "left").select(*KEY, "idx", F.round(F.least(F.lit(100.0), score), 4).alias("score"))


@query(with_tables("""select clip_id, cast(case when n = 0 then 45 when n <= 3 then 70 + n * 5 else greatest(50, 85 - (n - 3) * 5) end as double) as score
    from (select s.clip_id, count(c.cut_ms) as n from segments s left join cuts c on c.video_id = s.video_id and s.s_ms < c.cut_ms and c.cut_ms < s.e_ms
    where s.status = 'suggested' group by all)""", "segments", more=_CUTS))
def scene_scores(spark, folder):
    from reelgrid.plans.interval_sets import cuts_inside_clips
    return cuts_inside_clips(spark, folder).select("clip_id", sg.scene_score(F.col("n_cuts")).cast("double").alias("score"))


@query(with_tables("""select video_id, idx, score, round(cast(case when n = 0 then score else 0.5 * score + 0.5 * round(10.0 * acts / n, 1) end as double), 1) as rescored from (
    select w.video_id, w.idx, w.idx * 7 % 100 as score, count(s.sec) as n, sum(s.motion % 11) as acts from sentences w
    left join signal s on s.video_id = w.video_id and w.start_ms <= s.sec * 1000 and s.sec * 1000 <= w.end_ms group by all)""", "signal", "sentences"))
def visual_rescore(spark, folder):
    frames = signal(spark, folder).select(*KEY, (F.col("sec") * 1000).alias("t_ms"), (F.col("motion") % 11).alias("act"))
    clips = sentences(spark, folder).select(*KEY, "idx", "start_ms", "end_ms", (F.col("idx") * 7 % 100).alias("score"))
    seen = (jn.points_in_spans(frames, clips, KEY, "t_ms", ("start_ms", "end_ms"), 60_000, "both")
            .groupBy(*KEY, "idx").agg(F.round(10.0 * F.sum("act") / F.count("*"), 1).alias("v")))
    mixed = F.when(F.col("v").isNull(), F.col("score").cast("double")).otherwise(0.5 * F.col("score") + 0.5 * F.col("v"))
    return clips.join(seen, [*KEY, "idx"], "left").select(*KEY, "idx", "score", F.round(mixed, 1).alias("rescored"))


@query(with_tables("select video_id, sec // 4 as second, least(100, max(motion)) as motion from signal group by all", "signal"))
def rollup_motion(spark, folder):
    return (signal(spark, folder).groupBy(*KEY, F.floor(F.col("sec") / 4).alias("second"))
            .agg(F.least(F.lit(100), F.max("motion")).alias("motion")))


@query(with_tables("""select w.video_id, w.idx, coalesce(round(avg(case when s.motion % 3 > 0 then s.motion / 100.0 end), 6), 0.5) as center
    from sentences w left join signal s on s.video_id = w.video_id and w.start_ms <= s.sec * 1000 and s.sec * 1000 <= w.end_ms group by all""", "signal", "sentences"))
def visible_face_center(spark, folder):
    faces = signal(spark, folder).filter("motion % 3 > 0").select(*KEY, (F.col("sec") * 1000).alias("t_ms"), (F.col("motion") / 100).alias("cx"))
    clips = sentences(spark, folder).select(*KEY, "idx", "start_ms", "end_ms")
    seen = jn.points_in_spans(faces, clips, KEY, "t_ms", ("start_ms", "end_ms"), 60_000, "both").groupBy(*KEY, "idx").agg(F.round(F.avg("cx"), 6).alias("c"))
    return clips.join(seen, [*KEY, "idx"], "left").select(*KEY, "idx", F.coalesce("c", F.lit(0.5)).alias("center"))


# ---- flagship: what is said under the loudest moments ----
_SPEECH = {"sent": f"select *, {N_TOKENS('norm')} as n_words, {is_junk_sql('norm')} as junk from (select video_id, idx, start_ms, end_ms, {NORM('text')} as norm from sentences)",
           "hits": """select l.video_id, l.from_sec, l.to_sec, l.ratio, l.rank, s.idx, s.n_words, s.junk from loud_top l join sent s
              on s.video_id = l.video_id and s.end_ms > l.from_sec * 1000 and s.start_ms < l.to_sec * 1000"""}


@query(with_tables("""select video_id, from_sec, to_sec, ratio, rank, count(*) as n_sentences, cast(sum(n_words) as bigint) as n_words,
    cast(sum(case when junk then n_words else 0 end) as bigint) as junk_words from hits group by all""", "signal", "sentences", more=_LOUD | _SPEECH))
def loud_speech_evidence(spark, folder):
    loud = sg.loud_islands(signal(spark, folder), KEY, CHUNK).withColumns(
        {"ls": F.col("from_sec") * 1000, "le": F.col("to_sec") * 1000})
    spoken = (sentences(spark, folder).withColumn("norm", tx.norm_text(F.col("text")))
              .select(*KEY, "start_ms", "end_ms", tx.n_tokens(F.col("norm")).alias("w"), tx.is_junk(F.col("norm")).alias("junk")))
    pairs = jn.overlap_join(loud, spoken, KEY, ("ls", "le"), ("start_ms", "end_ms"), 60_000)
    return pairs.groupBy(*KEY, "from_sec", "to_sec", "ratio", "rank").agg(
        F.count("*").alias("n_sentences"), F.sum("w").alias("n_words"),
        F.sum(F.when(F.col("junk"), F.col("w")).otherwise(0)).alias("junk_words"))
