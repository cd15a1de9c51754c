"""Clip filters with keep-something rules, judges and reply order."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import selection as sel
from reelgrid.plans.registry import query
from reelgrid.sources.standins import segments, with_tables

KEY = ["order_id"]      # an order is a video here: one to many clips each


def _clips(spark, folder):
    return segments(spark, folder).select("order_id", "clip_id", "s_ms", "e_ms", "score")


@query(with_tables("""select clip_id, reason, reason is null or not bool_or(reason is null) over (partition by order_id) as kept from (
    select *, case when e_ms * 100 <= 4500000 * 4 then 'intro' when s_ms * 100 >= 4500000 * 97 then 'outro'
      when s_ms * 100 >= 4500000 * 60 then null end as reason from segments)""", "segments"))
def intro_outro_filter(spark, folder):
    t = _clips(spark, folder).withColumn("dur", F.lit(4_500_000))
    return sel.intro_outro(t, KEY, "s_ms", "e_ms", "dur").select("clip_id", "reason", "kept")


@query(with_tables("""select clip_id from (select *, count(*) over w as n, max(score) over w as top, row_number() over (partition by order_id order by score desc, clip_id) as rn
    from segments window w as (partition by order_id)) where n < 2 or score >= 55 or (top < 55 and rn = 1)""", "segments"))
def quality_floor(spark, folder):
    return sel.quality_floor(_clips(spark, folder), KEY, "score", "clip_id").select("clip_id")


_RANKED = {"r": "select *, max(score) over (partition by order_id) as top, row_number() over (partition by order_id order by score desc, clip_id) as rn from segments"}


@query(with_tables("select clip_id from r where top <= 0 or score * 100 >= greatest(2800, top * 72) or rn = 1", "segments", more=_RANKED))
def adaptive_floor(spark, folder):
    return sel.adaptive_floor(_clips(spark, folder), KEY, "score", "clip_id").select("clip_id")


@query(with_tables("select clip_id from r where top <= 0 or (score >= 28 and rn <= 3) or rn = 1", "segments", more=_RANKED))
def adaptive_floor_parts(spark, folder):
    return sel.adaptive_floor(_clips(spark, folder), KEY, "score", "clip_id", parts=3).select("clip_id")


@query(with_tables("""select order_id, coalesce(round(quantile_cont(score, 0.5), 1), max(old)) as score, count(score) as votes, arg_min(reason, case when trim(reason) <> '' then clip_id end) as reason
    from (select order_id, clip_id, score as old, case when score % 5 > 0 then score end as score, case when score % 2 = 0 then 'r' || score else ' ' end as reason from segments) group by 1""", "segments"))
def panel_scores(spark, folder):
    v = _clips(spark, folder).select("order_id", F.col("clip_id").alias("judge"), F.when(F.col("score") % 5 > 0, F.col("score")).alias("score"),
                                     F.when(F.col("score") % 2 == 0, F.concat(F.lit("r"), F.col("score").cast("string"))).otherwise(" ").alias("reason"))
    old = _clips(spark, folder).groupBy("order_id").agg(F.max("score").cast("double").alias("old_score"))
    return sel.panel_score(v, KEY, old)


@query(with_tables("select clip_id, round(cast(case when llm is null then 0.6 * a + 0.4 * s else 0.5 * llm + 0.3 * a + 0.2 * s end as double), 4) as score from (select clip_id, score * 1.0 as a, (score * 7 % 101) * 1.0 as s, case when score % 4 > 0 then (score * 3 % 101) * 1.0 end as llm from segments)", "segments"))
def fused_scores(spark, folder):
    a, s = F.col("score"), F.col("score") * 7 % 101
    llm = F.when(F.col("score") % 4 > 0, F.col("score") * 3 % 101)
    mixed = F.when(llm.isNull(), 0.6 * a + 0.4 * s).otherwise(0.5 * llm + 0.3 * a + 0.2 * s)
    return _clips(spark, folder).select("clip_id", F.round(mixed, 4).alias("score"))


_REPLY = {
    "items": "select order_id, row_number() over (partition by order_id order by clip_id) - 1 as idx from segments",
    "reply": "select order_id, score as pos, score % 6 as idx, score % 7 <> 0 as usable from segments where score % 3 > 0",
    "f": "select i.order_id, i.idx, min(r.pos) as pos, coalesce(bool_or(not r.usable), false) as bad0 from items i left join reply r using (order_id, idx) group by all",
    "g": """select *, bad0 and count_if(bad0) over (partition by order_id) < count(*) over (partition by order_id) as bad, bool_or(pos is not null) over (partition by order_id) as anyv from f""",
    "h": "select *, bool_or(pos is not null and not bad) over (partition by order_id) as clean from g",
    "t": """select *, case when not anyv or (pos is not null and (not bad or not clean)) then 0 when not bad then 1 else 2 end as turn,
       case when anyv and pos is not null and (not bad or not clean) then pos else idx end as place from h
       where not (anyv and pos is not null and bad and clean)"""}


@query(with_tables("""select order_id, idx, rank from (select *, case when anyv then row_number() over (partition by order_id order by turn, place, idx) else idx + 1 end as rank from t)
    where not anyv or rank <= 3""", "segments", more=_REPLY))
def reorder_by_reply(spark, folder):
    from reelgrid.operators.scan import row_number, scan
    t = segments(spark, folder)
    items = (scan(t.select("order_id", "clip_id"), KEY, ["clip_id"], F.floor(F.col("clip_id") / 10**12), n=row_number())
             .select("order_id", (F.col("n") - 1).alias("idx")))
    s = F.col("score")
    reply = t.filter(s % 3 > 0).select("order_id", s.alias("pos"), (s % 6).alias("idx"), (s % 7 != 0).alias("usable"))
    return sel.reorder_by_keep(items, reply, KEY, 3)
