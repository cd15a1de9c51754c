"""Interval-set queries over clip segments (a supplier is a video, one second is one day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import intervals as iv
from reelgrid.operators import joins as jn
from reelgrid.plans.registry import query
from reelgrid.sources.standins import segments, with_tables

CHUNK, BUCKET = 600_000, 60_000       # ten minutes of timeline per scan group, one per join group
KEY = ["video_id"]

_MERGE = """
 {out} as (select video_id, min({s}) as s_ms, max({e}) as e_ms from (
   select *, sum(brk) over (partition by video_id order by {s}, {e} rows unbounded preceding) as isl from (
   select *, case when {s} > coalesce(max({e}) over (partition by video_id order by {s}, {e}
       rows between unbounded preceding and 1 preceding), -1e18) + {gap} then 1 else 0 end as brk from {src}))
   group by video_id, isl)"""


def merged_cte(src: str, out: str, s: str = "s_ms", e: str = "e_ms", gap: int = 0) -> str:
    return _MERGE.format(src=src, out=out, s=s, e=e, gap=gap).split(" as ", 1)[1].strip()[1:-1]


@query(with_tables("select * from m", "segments", more={
    "used": "select * from segments where status in ('suggested','exported','done','archived')",
    "m": merged_cte("used", "m", gap=400)}))
def merge_used_ranges(spark, folder):
    used = segments(spark, folder).filter(F.col("status").isin("suggested", "exported", "done", "archived"))
    return iv.merge_ranges(used, KEY, "s_ms", "e_ms", CHUNK, 400)


def _status(df, *names):
    return df.filter(F.col("status").isin(*names))


@query(with_tables("""select video_id, s_ms, e_ms from (select *, bool_or(e_ms - s_ms >= 40000) over (partition by video_id) as a from m)
    where e_ms - s_ms >= 40000 or not a""", "segments", more={
    "src": "select * from segments where status = 'suggested'", "m": merged_cte("src", "m", gap=1199)}))
def smooth_pieces(spark, folder):
    return iv.smooth_ranges(_status(segments(spark, folder), "suggested"), KEY, "s_ms", "e_ms",
                            CHUNK, 1200, 40_000)


_FREE = {
    "win": "select * from segments where status = 'suggested'",
    "u": "select * from segments where status = 'exported'",
    "m": merged_cte("u", "m"),
    "w2": "select video_id, s_ms - 500 as s_ms, e_ms + 500 as e_ms from m",
    "blk": merged_cte("w2", "blk"),
    "free": """select video_id, coalesce(lag(e_ms) over (partition by video_id order by s_ms), -1000000000) as fs, s_ms as fe from blk
      union all select video_id, max(e_ms), 1000000000000 from blk group by video_id
      union all select distinct video_id, -1000000000, 1000000000000 from win where video_id not in (select video_id from blk)""",
}


@query(with_tables("""select clip_id, video_id, greatest(s_ms, fs) as piece_s, least(e_ms, fe) as piece_e
    from win join free using (video_id) where e_ms > fs and s_ms < fe
    and least(e_ms, fe) - greatest(s_ms, fs) >= 3000""", "segments", more=_FREE))
def subtract_used(spark, folder):
    t = segments(spark, folder)
    left = iv.subtract_ranges(_status(t, "suggested"), _status(t, "exported").select("video_id", "s_ms", "e_ms")
                              .withColumnsRenamed({"s_ms": "us", "e_ms": "ue"}), KEY, "s_ms", "e_ms",
                              "us", "ue", CHUNK, BUCKET)
    return left.select("clip_id", "video_id", "piece_s", "piece_e")


_COVER = {k: _FREE[k] for k in ("win", "u", "m")} | {
    "cov": """select w.clip_id, w.video_id, w.s_ms, w.e_ms,
      cast(coalesce(sum(case when m.s_ms is not null then least(w.e_ms, m.e_ms) - greatest(w.s_ms, m.s_ms) end), 0) as bigint) as covered
      from win w left join m on w.video_id = m.video_id and w.e_ms > m.s_ms and w.s_ms < m.e_ms group by all"""}


def _covered(spark, folder):
    t = segments(spark, folder)
    used = _status(t, "exported").select("video_id", F.col("s_ms").alias("us"), F.col("e_ms").alias("ue"))
    cand = _status(t, "suggested").select("clip_id", "video_id", "s_ms", "e_ms")
    return iv.covered_length(cand, used, KEY, ["clip_id"], ("s_ms", "e_ms"), ("us", "ue"), CHUNK, BUCKET)


@query(with_tables("select * from cov", "segments", more=_COVER))
def covered_fraction(spark, folder):
    return _covered(spark, folder)


@query(with_tables("""select clip_id, video_id, covered, exhausted from (select *, not bool_or(covered * 100 <= 30 * (e_ms - s_ms))
    over (partition by video_id) as exhausted from cov) where exhausted or covered * 100 <= 30 * (e_ms - s_ms)""",
                   "segments", more=_COVER))
def filter_used_candidates(spark, folder):
    return iv.filter_used(_covered(spark, folder), KEY, "s_ms", "e_ms").select(
        "clip_id", "video_id", "covered", "exhausted")


@query(with_tables("""select a.clip_id, count(*) as n, cast(sum(least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) as bigint) as shared_ms
    from segments a join segments b on a.video_id = b.video_id and a.e_ms > b.s_ms and a.s_ms < b.e_ms
    where a.status = 'suggested' and b.status = 'archived' group by all""", "segments"))
def overlap_pairs(spark, folder):
    t = segments(spark, folder)
    old = _status(t, "archived").select("video_id", F.col("s_ms").alias("os"), F.col("e_ms").alias("oe"))
    pairs = jn.overlap_join(_status(t, "suggested").select("video_id", "clip_id", "s_ms", "e_ms"), old, KEY,
                            ("s_ms", "e_ms"), ("os", "oe"), BUCKET)
    return pairs.groupBy("clip_id").agg(
        F.count("*").alias("n"), F.sum(F.least("e_ms", "oe") - F.greatest("s_ms", "os")).alias("shared_ms"))


_GROUPED = {"g": "select video_id, order_id // 1000 as clip_no, s_ms, e_ms, score from segments"}
_PAIRS = """select a.video_id, a.clip_no as clip_a, b.clip_no as clip_b,
    cast(sum(least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) as bigint) as shared
    from g a join g b on a.video_id = b.video_id and a.clip_no < b.clip_no and a.e_ms > b.s_ms and a.s_ms < b.e_ms
    group by all"""


def _grouped(spark, folder, per=1000):
    return segments(spark, folder).select(
        "video_id", F.floor(F.col("order_id") / per).alias("clip_no"), "s_ms", "e_ms", "score")


@query(with_tables(_PAIRS, "segments", more=_GROUPED))
def shared_seconds(spark, folder):
    return iv.shared_time(_grouped(spark, folder), KEY, "clip_no", "s_ms", "e_ms", BUCKET)


_GREEDY = """, walk as (
  select video_id, 0 as n, cast([] as {t}[]) as kept from (select distinct video_id from ranked)
  union all
  select w.video_id, r.rn, case when {clash} then w.kept else list_append(w.kept, {me}) end
  from walk w join ranked r on r.video_id = w.video_id and r.rn = w.n + 1)
select video_id, unnest(kept).c as clip_id from (select video_id, arg_max(kept, n) as kept from walk group by 1)"""


def _greedy_sql(order: str, num: int, den: int, where: str = "true") -> str:
    """Greedy walk in SQL: rows that clash with a kept row are skipped, one recursion per rank."""
    body = _GREEDY.format(
        t="struct(c bigint, s bigint, e bigint)",
        me="struct_pack(c := r.clip_id, s := r.s_ms, e := r.e_ms)",
        clash=f"""len(list_filter(w.kept, lambda k: least(k.e, r.e_ms) - greatest(k.s, r.s_ms) > 0
          and (least(k.e, r.e_ms) - greatest(k.s, r.s_ms)) * {den} > {num} * least(k.e - k.s, r.e_ms - r.s_ms))) > 0""")
    head = with_tables("", "segments", more={
        "ranked": f"select *, row_number() over (partition by video_id order by {order}) as rn from segments where {where}"})
    return head + body


@query(_greedy_sql("s_ms, clip_id", 55, 100))
def greedy_by_start(spark, folder):
    return iv.greedy_non_overlap(segments(spark, folder), KEY, ["clip_id"], "s_ms", "e_ms",
                                 ["s_ms", "clip_id"], (55, 100), CHUNK, BUCKET, by_start=True).select("video_id", "clip_id")


@query(_greedy_sql("score desc, clip_id", 25, 100))
def greedy_by_score(spark, folder):
    t = segments(spark, folder).withColumn("neg", -F.col("score"))
    return iv.greedy_non_overlap(t, KEY, ["clip_id"], "s_ms", "e_ms", ["neg", "clip_id"], (25, 100),
                                 CHUNK, BUCKET).select("video_id", "clip_id")


@query("""with recursive segments as materialized (%s), g as (select video_id, order_id // 300 as clip_no, s_ms, e_ms, score from segments),
  c as (select video_id, clip_no, sum(e_ms - s_ms) as len, max(score) as score,
     row_number() over (partition by video_id order by max(score) desc, clip_no) as rn from g group by video_id, clip_no),
  p as (select a.video_id, a.clip_no as ca, b.clip_no as cb, sum(least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) as shared
     from g a join g b on a.video_id = b.video_id and a.clip_no <> b.clip_no and a.e_ms > b.s_ms and a.s_ms < b.e_ms group by all),
  bad as (select p.video_id, ca, list(cb) as foes from p join c x on x.video_id = p.video_id and x.clip_no = ca
     join c y on y.video_id = p.video_id and y.clip_no = cb where shared * 100 > 15 * least(x.len, y.len) group by all),
  walk as (select video_id, 0 as n, cast([] as bigint[]) as kept from (select distinct video_id from c)
    union all select w.video_id, c.rn, case when list_has_any(w.kept, coalesce(bad.foes, [])) then w.kept else list_append(w.kept, c.clip_no) end
    from walk w join c on c.video_id = w.video_id and c.rn = w.n + 1 left join bad on bad.video_id = c.video_id and bad.ca = c.clip_no)
  select c.video_id, c.clip_no, cast(c.len as bigint) as length, c.score from c join walk w on w.video_id = c.video_id
    and w.n = (select max(rn) from c x where x.video_id = c.video_id) where list_contains(w.kept, c.clip_no)"""
       % with_tables("", "segments").split("(", 1)[1].rsplit(")", 1)[0])
def drop_shared_footage(spark, folder):
    return iv.drop_shared_footage(_grouped(spark, folder, 300), KEY, "clip_no", "s_ms", "e_ms", "score", BUCKET)


@query(with_tables("", "segments", more={
    "t": "select video_id, s_ms, min(clip_id) as clip_id from segments where status = 'suggested' group by all",
    "r": "select *, row_number() over (partition by video_id order by s_ms) as rn from t"}) + """,
    walk as (select video_id, rn, s_ms, clip_id, s_ms as last, true as keep from r where rn = 1
      union all select r.video_id, r.rn, r.s_ms, r.clip_id, case when r.s_ms - w.last >= 7000 then r.s_ms else w.last end,
        r.s_ms - w.last >= 7000 from walk w join r on r.video_id = w.video_id and r.rn = w.rn + 1)
    select video_id, clip_id, s_ms from walk where keep""")
def spaced_labels(spark, folder):
    t = _status(segments(spark, folder), "suggested")
    return iv.min_spacing(t, KEY, "s_ms", ["clip_id"], 7000, CHUNK).select("video_id", "clip_id", "s_ms")


@query(with_tables("""select video_id, coalesce(bool_or(prev > s_ms), false) as overlaps from (
    select video_id, s_ms, lag(e_ms) over (partition by video_id order by s_ms, e_ms, clip_id) as prev from segments)
    group by video_id""", "segments"))
def any_overlap(spark, folder):
    t = segments(spark, folder)
    return iv.has_overlap(t, KEY, "s_ms", "e_ms", ["s_ms", "e_ms", "clip_id"], CHUNK)


@query(with_tables("""select order_id, seg_idx, s_ms, least(e_ms, s_ms + 75000 - before) as e_ms from (
    select *, coalesce(sum(e_ms - s_ms) over (partition by order_id order by seg_idx, clip_id rows between unbounded preceding and 1 preceding), 0) as before
    from segments) where before < 75000""", "segments"))
def cap_total_length(spark, folder):
    t = segments(spark, folder)
    kept = iv.keep_total(t, ["order_id"], ["seg_idx", "clip_id"], "s_ms", "e_ms", F.floor(F.col("seg_idx") / 512), 75_000)
    return kept.select("order_id", "seg_idx", "s_ms", "e_ms")


@query(with_tables("""select clip_id, cs, ce, bad from (select clip_id, greatest(s_ms, 0) as cs, least(e_ms, 2800000) as ce,
    least(e_ms, 2800000) - greatest(s_ms, 0) < 300 as bad from segments)""", "segments"))
def clamp_to_media(spark, folder):
    cs, ce = F.greatest("s_ms", F.lit(0)), F.least("e_ms", F.lit(2_800_000))
    return segments(spark, folder).select("clip_id", cs.alias("cs"), ce.alias("ce"), (ce - cs < 300).alias("bad"))


# ---- points, edges and boundaries ----
_CUTS = {"cuts": "select distinct video_id, s_ms + 500 as cut_ms from segments where status = 'archived'"}


def scene_cuts(spark, folder):
    return (_status(segments(spark, folder), "archived")
            .select("video_id", (F.col("s_ms") + 500).alias("cut_ms")).distinct())


@query(with_tables("""select s.clip_id, count(c.cut_ms) as n_cuts from segments s left join cuts c on c.video_id = s.video_id
    and s.s_ms < c.cut_ms and c.cut_ms < s.e_ms where s.status = 'suggested' group by all""", "segments", more=_CUTS))
def cuts_inside_clips(spark, folder):
    clips = _status(segments(spark, folder), "suggested").select("video_id", "clip_id", "s_ms", "e_ms")
    hits = jn.points_in_spans(scene_cuts(spark, folder), clips, KEY, "cut_ms", ("s_ms", "e_ms"), BUCKET, "neither")
    n = hits.groupBy("clip_id").agg(F.count("*").alias("n"))
    return clips.join(n, "clip_id", "left").select("clip_id", F.coalesce("n", F.lit(0)).alias("n_cuts"))


@query(with_tables("""select distinct video_id, t_ms from (select video_id, start_ms as t_ms from sentences
    union all select video_id, end_ms from sentences union all select video_id, start_ms + 1700 from sentences where idx % 2 = 0)""",
                   "sentences"))
def natural_boundaries(spark, folder):
    from reelgrid.sources.standins import sentences
    s = sentences(spark, folder)
    cuts = s.filter("idx % 2 = 0").select("video_id", (F.col("start_ms") + 1700).alias("t_ms"))
    return (s.select("video_id", F.explode(F.array("start_ms", "end_ms")).alias("t_ms"))
            .unionByName(cuts).distinct())


_EDGES = {"pts": "select video_id, clip_id, e_ms as t_ms from segments where status = 'suggested'",
          "edges": "select distinct video_id, s_ms + 300 as edge_ms from segments where status = 'exported'"}


@query(with_tables("""select clip_id, t_ms, case when best is not null then best else t_ms end as snapped from (
    select p.clip_id, p.t_ms, (select arg_min(e.edge_ms, abs(e.edge_ms - p.t_ms) * 100000000 + e.edge_ms) from edges e
      where e.video_id = p.video_id and abs(e.edge_ms - p.t_ms) <= 1500) as best from pts p)""", "segments", more=_EDGES))
def snap_to_edges(spark, folder):
    t = segments(spark, folder)
    pts = _status(t, "suggested").select("video_id", "clip_id", F.col("e_ms").alias("t_ms"))
    edges = _status(t, "exported").select("video_id", (F.col("s_ms") + 300).alias("edge_ms"))
    return jn.snap(pts, edges, KEY, "t_ms", "edge_ms", 1500, CHUNK).select("clip_id", "t_ms", "snapped")


@query(with_tables("""select clip_id, t_ms, case when cut is not null and not exists (select 1 from sent s where s.video_id = q.video_id
      and s.start_ms + 150 < cut and cut < s.end_ms - 150) then cut when best is not null then best else t_ms end as snapped from (
    select p.video_id, p.clip_id, p.t_ms, (select arg_min(e.edge_ms, abs(e.edge_ms - p.t_ms) * 100000000 + e.edge_ms) from edges e
      where e.video_id = p.video_id and abs(e.edge_ms - p.t_ms) <= 1500) as best,
     (select arg_min(c.cut_ms, abs(c.cut_ms - p.t_ms) * 100000000 + c.cut_ms) from cuts c
      where c.video_id = p.video_id and abs(c.cut_ms - p.t_ms) <= 2000) as cut from pts p) q""", "segments", more=_EDGES | _CUTS | {
    "sent": "select video_id, s_ms as start_ms, s_ms + 3000 as end_ms from segments where status = 'exported'"}))
def snap_to_scene_cuts(spark, folder):
    t = segments(spark, folder)
    pts = _status(t, "suggested").select("video_id", "clip_id", F.col("e_ms").alias("t_ms"))
    edges = _status(t, "exported").select("video_id", (F.col("s_ms") + 300).alias("edge_ms"))
    spoken = _status(t, "exported").select("video_id", F.col("s_ms").alias("start_ms"),
                                           (F.col("s_ms") + 3000).alias("end_ms"))
    out = jn.snap_to_scene(pts, edges, scene_cuts(spark, folder), spoken, KEY, "t_ms", CHUNK)
    return out.select("clip_id", "t_ms", "snapped")


@query(with_tables("""select p.video_id, p.idx, p.t_ms, coalesce((select arg_min(case when p.t_ms - w.start_ms <= w.end_ms - p.t_ms then w.start_ms else w.end_ms end, w.start_ms)
    from words w where w.video_id = p.video_id and w.start_ms + 10 < p.t_ms and p.t_ms < w.end_ms - 10), p.t_ms) as whole_word_ms
    from (select video_id, idx, (start_ms + end_ms) // 2 as t_ms from sentences) p""", "words"))
def keep_words_whole(spark, folder):
    from reelgrid.sources.standins import sentences, words
    pts = sentences(spark, folder).select("video_id", "idx", F.expr("(start_ms + end_ms) div 2").alias("t_ms"))
    return jn.off_word(pts, words(spark, folder), KEY, ["idx"], "t_ms", BUCKET)


@query(with_tables("""select clip_id, coalesce(best, -1) as best_clip from (select a.clip_id,
    (select (list(b.clip_id order by least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms) desc, b.clip_id))[1] from segments b
     where b.status = 'exported' and b.video_id = a.video_id and b.e_ms > a.s_ms and b.s_ms < a.e_ms) as best
    from segments a where a.status = 'suggested')""", "segments"))
def best_overlap_segment(spark, folder):
    t = segments(spark, folder)
    a = _status(t, "suggested").select("video_id", "clip_id", "s_ms", "e_ms")
    b = _status(t, "exported").select("video_id", F.col("clip_id").alias("other"), F.col("s_ms").alias("os"), F.col("e_ms").alias("oe"))
    share = F.least("e_ms", "oe") - F.greatest("s_ms", "os")
    best = (jn.overlap_join(a, b, KEY, ("s_ms", "e_ms"), ("os", "oe"), BUCKET)
            .groupBy("clip_id").agg(F.max_by("other", F.struct(share, -F.col("other"))).alias("best")))
    return a.join(best, "clip_id", "left").select("clip_id", F.coalesce("best", F.lit(-1)).alias("best_clip"))


@query(with_tables("""select a.clip_id, b.clip_id as window_id from segments a join segments b on a.video_id = b.video_id
    where a.status = 'suggested' and b.status = 'exported'
    and b.s_ms - 10 <= (a.s_ms + a.e_ms) // 2 and (a.s_ms + a.e_ms) // 2 <= b.e_ms + 10""", "segments"))
def assign_by_midpoint(spark, folder):
    t = segments(spark, folder)
    mids = _status(t, "suggested").select("video_id", "clip_id", F.expr("(s_ms + e_ms) div 2").alias("mid"))
    wins = _status(t, "exported").select(
        "video_id", F.col("clip_id").alias("window_id"), "s_ms", "e_ms")
    return jn.points_in_spans(mids, wins, KEY, "mid", ("s_ms", "e_ms"), BUCKET, "both", 10).select("clip_id", "window_id")
