"""Whole selection jobs: highlight clips without and with judged scores, and the mixed cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import text as tx
from reelgrid.operators import intervals as iv, joins as jn, selection as sel, shaping as sh, signals as sg, transcripts as tr
from reelgrid.operators.scan import row_number, scan
from reelgrid.plans.registry import query
from reelgrid.plans.sqltext import N_TOKENS, NORM, is_junk_sql
from reelgrid.sources.standins import sentences, signal, with_tables
from reelgrid.session import checkpointed

KEY, CHUNK, BUCKET = ["video_id"], 600_000, 60_000
LOW, HIGH = 20_000, 40_000

_CAND = {
    "anc": """select video_id, idx as anchor, start_ms as a, 20000 + (cast('0x' || substr(md5(video_id || ':' || idx), 1, 8) as bigint) % 20001
        + cast('0x' || substr(md5(video_id || ':' || idx), 9, 8) as bigint) % 20001) // 2 as target from sentences""",
    "sft": """select video_id, idx, end_ms, regexp_matches(rtrim(text), '[.?!…]"?$') or exists (select 1 from sentences c where c.video_id = s.video_id and c.idx % 2 = 0
        and abs(s.end_ms - (c.start_ms + 1700)) < 600) as soft from sentences s""",
    "far": """select a.video_id, a.anchor, a.a, min(case when (s.end_ms - a >= target and (soft or s.end_ms - a >= target + 8000)) or s.end_ms - a >= 40000 then s.end_ms end) as stop, max(s.end_ms) as far
        from anc a join sft s on s.video_id = a.video_id and s.end_ms > a.a group by all""",
    "cand": """select f.video_id, anchor, a as s_ms, least(coalesce(stop, far), a + 40000) as e_ms from far f join (select video_id, max(end_ms) as le from sentences group by 1) using (video_id)
        where least(coalesce(stop, far), a + 40000) - a >= 19500 or (least(coalesce(stop, far), a + 40000) >= le - 500 and (least(coalesce(stop, far), a + 40000) - a) * 2 >= 20000)"""}


def _cuts(s):
    return s.filter("idx % 2 = 0").select("video_id", (F.col("start_ms") + 1700).alias("cut_ms"))


def _windows(s):
    closed = s.select("video_id", "idx", "start_ms", "end_ms", F.rtrim("text").rlike(r'[.?!…]"?$').alias("closes"))
    return sh.candidate_windows(closed, _cuts(s), KEY, LOW, HIGH, CHUNK, BUCKET)


@query(with_tables("select * from cand", "sentences", more=_CAND))
def candidate_windows(spark, folder):
    return _windows(sentences(spark, folder))


def _picked(spark, folder, limit):
    """Ranked candidates: no strong overlap, scored by loudness, spread over the video."""
    s = sentences(spark, folder)
    duration = s.groupBy("video_id").agg(F.max("end_ms").alias("duration"))
    cand = iv.greedy_non_overlap(_windows(s), KEY, KEY + ["anchor"], "s_ms", "e_ms", ["s_ms", "anchor"], (55, 100), CHUNK, BUCKET, by_start=True)
    cand = checkpointed(cand)          # every step below reads its input twice
    used = s.filter("idx % 5 = 3").select("video_id", F.col("start_ms").alias("us"), F.col("end_ms").alias("ue"))
    cand = iv.filter_used(iv.covered_length(cand, used, KEY, ["anchor"], ("s_ms", "e_ms"), ("us", "ue"), CHUNK, BUCKET), KEY, "s_ms", "e_ms")
    cand = checkpointed(cand)
    marks = tr.scored_sentences(s, KEY)
    junk = tr.window_speech(cand, marks, KEY, ["anchor"], "s_ms", "e_ms", BUCKET).select("video_id", "anchor", "junk_ratio")
    cand = cand.join(junk, ["video_id", "anchor"]).join(duration, "video_id")
    edge = (F.col("s_ms") * 100 <= F.col("duration") * 3) | (F.col("e_ms") * 100 >= F.col("duration") * 97)
    cand = sel.with_fallback(cand.withColumn("good", ~(edge & (F.col("junk_ratio") > 0.30))), KEY, "good")
    cand = checkpointed(cand)
    win = cand.withColumns({"ws": F.floor(F.col("s_ms") / 1000), "we": F.floor(F.col("e_ms") / 1000)})
    base = sg.audio_base(signal(spark, folder), win, KEY, ["anchor"], "ws", "we", 60)
    loud = F.coalesce((6 * F.col("rms_sum") / F.col("rms_n") + 4 * F.col("rms_max")) / 100, F.lit(0.0))
    cand = win.join(base, ["video_id", "anchor"], "left").withColumn("audio", F.round(F.least(F.lit(100.0), loud), 4))
    ranked = scan(cand.withColumn("neg", -F.col("audio")), KEY, ["neg", "anchor"], F.floor(F.col("neg") / 10), rk=row_number())
    ranked = checkpointed(ranked.select("video_id", "anchor", "s_ms", "e_ms", "duration", "audio", "rk"))
    gap = F.greatest(F.lit(30_000), F.floor(F.col("duration") * 8 / 100))
    return s, marks, sh.spread_pick(ranked, KEY, "anchor", "s_ms", "e_ms", "rk", "duration", limit, gap)


@query()
def spread_candidates(spark, folder):
    return _picked(spark, folder, 3)[2].select("video_id", "anchor", "s_ms", "e_ms", "audio")


@query()
def select_highlights_heuristic(spark, folder):
    s, marks, picked = _picked(spark, folder, 12)
    picked = checkpointed(picked.select("video_id", "anchor", "s_ms", "e_ms", "duration", "audio"))
    trimmed = sh.trim_junk_edges(picked.withColumn("seg_idx", F.lit(0)), marks, KEY, "anchor", BUCKET, LOW - 2000)
    clips = (trimmed.groupBy("video_id", "anchor").agg(F.min("s_ms").alias("first_s"), F.max("e_ms").alias("last_e"), F.sum(F.col("e_ms") - F.col("s_ms")).alias("total"))
             .join(picked.select("video_id", "anchor", "duration", "audio"), ["video_id", "anchor"]))
    clips = checkpointed(clips)
    edges = s.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("edge_ms")).distinct()
    sized = sh.enforce_length(clips, edges, KEY, "anchor", LOW, "duration", BUCKET)
    sized = checkpointed(sized)
    n = (jn.points_in_spans(_cuts(s), sized, KEY, "cut_ms", ("first_s", "last_e"), BUCKET, "neither")
         .groupBy("video_id", "anchor").agg(F.count("*").alias("n")))
    out = sized.join(n, ["video_id", "anchor"], "left").join(picked.select("video_id", "anchor", "audio"), ["video_id", "anchor"])
    score = 0.6 * F.col("audio") + 0.4 * sg.scene_score(F.coalesce("n", F.lit(0)))
    out = out.withColumn("score", F.round(score, 2))
    return scan(out, KEY, ["first_s", "anchor"], F.floor(F.col("first_s") / CHUNK), part=row_number()).select(
        "video_id", "part", "anchor", "first_s", "last_e", "score", "too_short")


_EXTEND = {
    "mk": f"select *, row_number() over (partition by video_id order by start_ms, idx) as rn from (select video_id, idx, start_ms, end_ms, {is_junk_sql('norm')} as junk from (select *, {NORM('text')} as norm from sentences))",
    "cl": """select c.video_id, c.idx as clip_id, c.end_ms as e, c.end_ms - c.start_ms as total, min(m.rn) - 1 as rn, cast(null as bigint) as piece_s from mk c
       join mk m on m.video_id = c.video_id and m.end_ms > c.end_ms + 50 where c.end_ms - c.start_ms < 30000 group by c.video_id, c.idx, c.start_ms, c.end_ms"""}


@query(with_tables("""select video_id, clip_id, piece_s, e as piece_e from (
    with recursive ex as (select video_id, clip_id, e, total, rn, piece_s from cl
      union all select video_id, clip_id, case when skip then e else end_ms end, case when skip then total else total + end_ms - b end, nrn, case when not skip then b end
      from (select x.*, m.start_ms, m.end_ms, m.junk, m.rn as nrn, case when m.start_ms - x.e <= 6000 then x.e else m.start_ms end as b, m.end_ms <= x.e + 50 as skip
            from ex x join mk m on m.video_id = x.video_id and m.rn = x.rn + 1 where x.total < 30000)
      where skip or not (start_ms - e > 8000 or junk or total + end_ms - b > 60500))
    select * from ex) where piece_s is not null""", "sentences", more=_EXTEND))
def extend_to_target(spark, folder):
    s = sentences(spark, folder)
    clips = s.filter("end_ms - start_ms < 30000").select("video_id", F.col("idx").alias("clip_id"), F.col("end_ms").alias("last_e"), (F.col("end_ms") - F.col("start_ms")).alias("total"))
    return sh.extend_to_target(clips, tr.scored_sentences(s, KEY), KEY, "clip_id", 30_000, 60_000, BUCKET)


_TRIM = {
    "sent": f"select video_id, idx, start_ms, end_ms, {is_junk_sql('norm')} as junk from (select *, {NORM('text')} as norm from doc_lines)",
    # two pieces a clip; the front is pared (phase 1) before the back (2)
    "walk": """select video_id, idx as clip_id, [{'s': start_ms, 'e': start_ms + 30000}, {'s': start_ms + 35000, 'e': start_ms + 65000}] as p, 1 as phase, 0 as k from doc_lines union all
      select video_id, clip_id, case when ok then new else p end, case when ok then phase else phase + 1 end, case when ok then k + 1 else 0 end
      from (select *, k < 3 and x.junk and x.s < rim.e - 10 and x.e > rim.s + 10 and coalesce(list_sum(list_transform(new, lambda r: r.e - r.s)), 0) >= 15000 as ok from (
        select *, list_filter(case when phase = 1 then [{'s': greatest(p[1].s, x.e), 'e': p[1].e}] || p[2:] else p[:len(p) - 1] || [{'s': p[len(p)].s, 'e': least(p[len(p)].e, x.s)}] end,
            lambda r: r.e - r.s >= 1000) as new, case when phase = 1 then p[1] else p[len(p)] end as rim from (
        select w.video_id, w.clip_id, w.p, w.phase, w.k, arg_min({'s': s.start_ms, 'e': s.end_ms, 'junk': s.junk}, case when w.phase = 1 then {'a': s.start_ms, 'i': s.idx} else {'a': -s.start_ms, 'i': -s.idx} end) as x
        from walk w left join sent s on s.video_id = w.video_id and len(list_filter(w.p, lambda r: s.end_ms > r.s and s.start_ms < r.e)) > 0 where w.phase < 3 group by w.video_id, w.clip_id, w.p, w.phase, w.k)))"""}


@query(with_tables("""select video_id, clip_id, cast(i - 1 as integer) as seg_idx, p[i].s as s_ms, p[i].e as e_ms from (select *, unnest(generate_series(1, len(p))) as i from walk where phase = 3)""",
                   "doc_lines", more=_TRIM).replace("walk as materialized", "walk as"))
def trim_junk_edges(spark, folder):
    from reelgrid.sources.standins import doc_lines
    d = doc_lines(spark, folder)
    marks = tr.scored_sentences(d, KEY)
    pieces = F.explode(F.array(*[F.struct((F.col("start_ms") + a).alias("s_ms"), (F.col("start_ms") + b).alias("e_ms")) for a, b in ((0, 30_000), (35_000, 65_000))]))
    segs = d.select("video_id", F.col("idx").alias("clip_id"), pieces.alias("x")).select("video_id", "clip_id", "x.*")
    return sh.trim_junk_edges(segs, marks, KEY, "clip_id", BUCKET)


@query(with_tables("""select video_id, idx as clip_id, first_s, case when add_e > 0 then end_e else last_e end as mid_e from (select *, case when least(coalesce(up, t), dur) - last_e < add_e - 500 then least(t, dur) else least(coalesce(up, t), dur) end as end_e from (
    select s.video_id, s.idx, s.start_ms as first_s, s.end_ms as last_e, d.dur, a.add_e, s.end_ms + a.add_e as t, (select max(e.edge_ms) from ed e where e.video_id = s.video_id and e.edge_ms between s.end_ms + a.add_e - 50 and s.end_ms + a.add_e + 2000) as up
    from sentences s join du d using (video_id), lateral (select case when s.end_ms - s.start_ms < 18000 and least(greatest(0, d.dur - s.end_ms), 20000 - (s.end_ms - s.start_ms)) > 10 then least(greatest(0, d.dur - s.end_ms), 20000 - (s.end_ms - s.start_ms)) else 0 end as add_e) a))""", "sentences", more={
    "du": "select video_id, max(end_ms) as dur from sentences group by 1",
    "ed": "select distinct video_id, unnest([start_ms, end_ms]) as edge_ms from sentences"}).replace("select video_id, idx as clip_id, first_s, case", "select video_id, idx as clip_id, case"))
def stretch_clip_ends(spark, folder):
    s = sentences(spark, folder)
    dur = s.groupBy("video_id").agg(F.max("end_ms").alias("duration"))
    clips = s.select("video_id", F.col("idx").alias("clip_id"), F.col("start_ms").alias("first_s"), F.col("end_ms").alias("last_e"),
                     (F.col("end_ms") - F.col("start_ms")).alias("total")).join(dur, "video_id")
    edges = s.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("edge_ms")).distinct()
    return sh.enforce_length(clips, edges, KEY, "clip_id", LOW, "duration", BUCKET).select("video_id", "clip_id", F.col("last_e").alias("mid_e"))


@query()
def mixed_cut(spark, folder):
    """Short moments by score without overlap until the target length, snapped to sentence edges."""
    from reelgrid.operators.intervals import top_per_key
    s = sentences(spark, folder)
    moments = sh.candidate_windows(s.select("video_id", "idx", "start_ms", "end_ms", F.rtrim("text").rlike(r'[.?!…]"?$').alias("closes")),
                                   _cuts(s), KEY, 6000, 16_000, CHUNK, BUCKET)
    win = moments.withColumns({"ws": F.floor(F.col("s_ms") / 1000), "we": F.floor(F.col("e_ms") / 1000)})
    base = sg.audio_base(signal(spark, folder), win, KEY, ["anchor"], "ws", "we", 60)
    loud = F.coalesce((6 * F.col("rms_sum") / F.col("rms_n") + 4 * F.col("rms_max")) / 100, F.lit(0.0))
    scored = win.join(base, ["video_id", "anchor"], "left").withColumn("neg", -F.round(F.least(F.lit(100.0), loud), 4))
    top = top_per_key(scored.select("video_id", "anchor", "s_ms", "e_ms", "neg"), KEY, [F.col("neg"), F.col("anchor")], 25).drop("rank")
    kept = iv.greedy_non_overlap(checkpointed(top), KEY, KEY + ["anchor"], "s_ms", "e_ms", ["neg", "anchor"], (0, 1), CHUNK, BUCKET)
    from reelgrid.operators.scan import running_sum
    order = scan(kept, KEY, ["neg", "anchor"], F.floor(F.col("neg") / 10), before=running_sum(F.col("e_ms") - F.col("s_ms"), False))
    chosen = order.filter(F.col("before") < 75_000).filter(F.col("before") + F.col("e_ms") - F.col("s_ms") <= 120_000)
    chosen = checkpointed(chosen)
    edges = s.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("edge_ms")).distinct()
    a = jn.snap(chosen.select("video_id", "anchor", "s_ms", "e_ms"), edges, KEY, "s_ms", "edge_ms", 1500, CHUNK, "cut_s")
    b = jn.snap(a, edges, KEY, "e_ms", "edge_ms", 1500, CHUNK, "cut_e")
    long = F.col("cut_e") - F.col("cut_s") >= 1000
    return b.select("video_id", "anchor", F.when(long, F.col("cut_s")).otherwise(F.col("s_ms")).alias("s_ms"),
                    F.when(long, F.col("cut_e")).otherwise(F.col("e_ms")).alias("e_ms"))


_JUDGED = {
    "sent": f"select video_id, idx, start_ms, end_ms, {N_TOKENS('norm')} as n_words, {is_junk_sql('norm')} as junk from (select *, {NORM('text')} as norm from doc_lines)",
    "cand": """select video_id, idx as cand, start_ms as s, least(start_ms + 40000, max(end_ms) over (partition by video_id)) as e, length(text) as n, max(end_ms) over (partition by video_id) as dur from doc_lines""",
    "vote": "select video_id, cand, unnest([0, 1, 2]) as judge, n, (n * (17 + 13 * judge) + cand * 7) % 101 as v from cand",
    "panel": "select video_id, cand, coalesce(round(quantile_cont(case when v % 5 > 0 then v end, 0.5), 1), 50.0) as score from vote group by 1, 2",
    "walk": """select video_id, cand as clip_id, [{'s': s, 'e': e}] as p, 1 as phase, 0 as k from cand union all
      select video_id, clip_id, case when ok then new else p end, case when ok then phase else phase + 1 end, case when ok then k + 1 else 0 end
      from (select *, k < 3 and x.junk and x.s < rim.e - 10 and x.e > rim.s + 10 and coalesce(list_sum(list_transform(new, lambda r: r.e - r.s)), 0) >= 18000 as ok from (
        select *, list_filter(case when phase = 1 then [{'s': greatest(p[1].s, x.e), 'e': p[1].e}] else [{'s': p[1].s, 'e': least(p[1].e, x.s)}] end, lambda r: r.e - r.s >= 1000) as new, p[1] as rim from (
        select w.video_id, w.clip_id, w.p, w.phase, w.k, arg_min({'s': s.start_ms, 'e': s.end_ms, 'junk': s.junk}, case when w.phase = 1 then {'a': s.start_ms, 'i': s.idx} else {'a': -s.start_ms, 'i': -s.idx} end) as x
        from walk w left join sent s on s.video_id = w.video_id and s.end_ms > w.p[1].s and s.start_ms < w.p[1].e where w.phase < 3 group by w.video_id, w.clip_id, w.p, w.phase, w.k)))""",
    "base": "select w.video_id, w.clip_id as cand, p[1].s as s_ms, p[1].e as e_ms, score, dur from walk w join panel p2 on p2.video_id = w.video_id and p2.cand = w.clip_id join cand c on c.video_id = w.video_id and c.cand = w.clip_id where phase = 3",
    "speech": """select b.video_id, b.cand, round(coalesce(sum(case when junk then n_words else 0 end) / nullif(sum(n_words), 0), 0), 6) as r from base b
       left join sent s on s.video_id = b.video_id and s.end_ms > b.s_ms and s.start_ms < b.e_ms group by 1, 2""",
    "ranked": "select *, row_number() over (partition by video_id order by score desc, cand) as rn from base join speech using (video_id, cand) where r <= 0.3",
    "gw": """select video_id, 0 as n, cast([] as struct(c bigint, s bigint, e bigint)[]) as kept from (select distinct video_id from ranked) union all
       select w.video_id, r.rn, case when len(list_filter(w.kept, lambda k: least(k.e, r.e_ms) - greatest(k.s, r.s_ms) > 0
          and (least(k.e, r.e_ms) - greatest(k.s, r.s_ms)) * 100 > 25 * least(k.e - k.s, r.e_ms - r.s_ms))) > 0 then w.kept else list_append(w.kept, {'c': r.cand, 's': r.s_ms, 'e': r.e_ms}) end
       from gw w join ranked r on r.video_id = w.video_id and r.rn = w.n + 1""",
    "apart": "select r.* from ranked r join (select video_id, unnest(kept).c as cand from (select video_id, arg_max(kept, n) as kept from gw group by 1)) using (video_id, cand)",
    "placed": """select *, why is null or not bool_or(why is null) over (partition by video_id) as stays from (
       select *, case when e_ms * 100 <= dur * 4 then 'intro' when s_ms * 100 >= dur * 97 then 'outro' end as why from apart)""",
    "scored": """select *, top <= 0 or score * 100 >= greatest(2800, top * 72) or place = 1 as good from (
       select *, max(score) over (partition by video_id) as top, row_number() over (partition by video_id order by score desc, cand) as place from placed where stays)""",
    "shown": """select *, fresh or not bool_or(fresh) over (partition by video_id) as unused from (select *, (select coalesce(sum(least(s.e_ms, d.end_ms) - greatest(s.s_ms, d.start_ms)), 0) from doc_lines d
       where d.video_id = s.video_id and length(d.text) % 4 = 0 and d.end_ms > s.s_ms and d.start_ms < s.e_ms) * 100 <= 30 * (s.e_ms - s.s_ms) as fresh from scored s where s.good)""",
    "best": "select *, row_number() over (partition by video_id order by score desc, cand) as nth from shown where unused"}


@query(with_tables("""select b.video_id, b.cand, b.s_ms, b.e_ms, cast(b.score as double) as score, f.part, case when f.part is not null then null when k.cand is null then 'junk' when a.cand is null then 'overlap' when not p.stays then p.why
      when not s.good then 'score' when not h.unused then 'used' else 'limit' end as reason
    from base b left join ranked k using (video_id, cand) left join apart a using (video_id, cand) left join placed p using (video_id, cand) left join scored s using (video_id, cand) left join shown h using (video_id, cand)
    left join (select video_id, cand, row_number() over (partition by video_id order by s_ms, cand) as part from best where nth <= 3) f using (video_id, cand)""", "doc_lines", more=_JUDGED)
       .replace("walk as materialized", "walk as").replace("gw as materialized", "gw as"))
def select_judged(spark, folder):
    from reelgrid.operators import judged as jd
    from reelgrid.sources.standins import doc_lines
    d = doc_lines(spark, folder)
    videos = d.groupBy("video_id").agg(F.max("end_ms").alias("duration"))
    cands = d.join(videos, "video_id").select("video_id", F.col("idx").alias("cand"), F.col("start_ms").alias("s_ms"), F.least(F.col("start_ms") + 40_000, F.col("duration")).alias("e_ms"))
    v = (F.length("text") * (17 + 13 * F.col("judge")) + F.col("idx") * 7) % 101
    votes = (d.withColumn("judge", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
             .select("video_id", F.col("idx").alias("cand"), "judge", F.when(v % 5 > 0, v).alias("score"), F.lit("").alias("reason")))
    used = d.filter(F.length("text") % 4 == 0).select("video_id", F.col("start_ms").alias("us"), F.col("end_ms").alias("ue"))
    return jd.select_judged(cands, votes, tr.scored_sentences(d, KEY), used, videos, KEY, "cand", 3, CHUNK, BUCKET)


_SPREAD = {"c": """select video_id, idx as cand, start_ms as s, row_number() over (partition by video_id order by length(text) desc, idx) - 1 as rank,
      floor(((start_ms + end_ms) // 2) * 4 / max(end_ms) over (partition by video_id)) as part, greatest(30000, max(end_ms) over (partition by video_id) * 8 // 100) as gap from doc_lines""",
           # one step for each part, then four by rank with the gap, then four without it
           "w": """select distinct video_id, 0 as t, cast([] as struct(c bigint, s bigint)[]) as kept from c union all
      select video_id, t + 1, case when x is null then kept else kept || [x] end from (
      select w.video_id, w.t, w.kept, arg_min({'c': c.cand, 's': c.s}, c.rank) as x from w left join c on c.video_id = w.video_id and len(w.kept) < 4 and (w.t >= 4 or c.part = w.t)
        and not list_contains(list_transform(w.kept, lambda k: k.c), c.cand) and (w.t >= 8 or len(list_filter(w.kept, lambda k: abs(k.s - c.s) < c.gap)) = 0)
      where w.t < 12 group by w.video_id, w.t, w.kept)"""}


@query(with_tables("select video_id, unnest(kept).c as cand from w where t = 12", "doc_lines", more=_SPREAD).replace("w as materialized", "w as", 1))
def spread_pick(spark, folder):
    """Four lines of each document spread over it, long ones first."""
    from reelgrid.sources.standins import doc_lines
    d = doc_lines(spark, folder).withColumn("neg", -F.length("text")).select("video_id", F.col("idx").alias("cand"), "start_ms", "end_ms", "neg")
    ranked = scan(d, KEY, ["neg", "cand"], F.floor(F.col("neg") / 16), n=row_number())
    ends = d.groupBy("video_id").agg(F.max("end_ms").alias("duration"))
    cands = ranked.join(ends, "video_id").withColumn("rank", F.col("n") - 1)
    return sh.spread_pick(cands, KEY, "cand", "start_ms", "end_ms", "rank", "duration", 4,
                          F.greatest(F.lit(30_000), F.floor(F.col("duration") * 8 / 100))).select("video_id", "cand")
