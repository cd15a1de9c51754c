"""Effect queries over the per-second signal: chosen accents, their share of a clip, and the whole plan from a coarser signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import fixed_values as fv
from reelgrid.operators import effects as ef, signals as sg
from reelgrid.plans.registry import query
from reelgrid.session import checkpointed
from reelgrid.sources.standins import sentences, signal, with_tables

KEY, CHUNK = ["video_id"], 600_000
_LIST = "case kind " + " ".join(f"when '{k}' then [{', '.join(repr(e) for e in v)}]" for k, v in fv.EFFECTS_BY_KIND.items()) + " end"
_MS = "map {" + ", ".join(f"'{k}': {v}" for k, v in fv.EFFECT_MS.items()) + "}"
_MED = """select video_id, quantile_cont(rms, 0.5) as mr, quantile_cont(motion, 0.5) as mm, max(rms) as xr, max(motion) as xm, count(*) as n, max(sec) + 1 as seconds from {src} group by 1"""
_MOMENT = """select video_id, sec, round(rms / case when mr = 0 then 1e-6 else mr end + motion / case when mm = 0 then 1e-6 else mm end
      + 1.5 * greatest(0, (rms - coalesce(recent, 0)) / case when mr = 0 then 1e-6 else mr end), 4) as score,
      case when exists (select 1 from ends j where j.video_id = q.video_id and abs(q.sec * 1000 - j.at_ms) <= 600) then 'join'
     when sec >= seconds - 3 then 'close' when motion <= mm * 0.55 then 'still' when mr > 0 and rms >= mr * 1.7 then 'peak'
     when mm > 0 and motion >= mm * 1.5 then 'action' else 'plain' end as kind from (
      select s.*, mr, mm, seconds, (select quantile_cont(p.rms, 0.5) from {src} p where p.video_id = s.video_id and p.sec between s.sec - 3 and s.sec - 1) as recent
      from {src} s join med using (video_id)) q"""
_CLIPS = """select video_id, seconds, video_id % 2 = 0 as opening,
    case when n < 3 or mr <= 0 then 0 else xr / mr end < 1.35 and case when n < 3 or mm <= 0 then 0 else xm / mm end < 1.35 as flat from med"""
#: The best moment that still fits, given the accents so far.
_NEXT = f"""select video_id, seconds, i + 1 as i, picks || [{{'s': spot, 'e': stop, 'fx': fx, 'kind': kind}}] as picks, left_ - (stop - spot) as left_ from (
    select *, row_number() over (partition by video_id order by kind <> 'opening', score desc, sec) as rn from (
    select *, case when kind = 'opening' then spot + least(450, greatest(300, ms)) else least(seconds * 1000 - 50, spot + greatest(300, least(800, ms))) end as stop from (
    select *, {_MS}[fx] as ms from (select *, fresh[1 + i % len(fresh)] as fx from (
    select p.*, m.sec, m.score, m.kind, case when m.kind = 'opening' then 120 else m.sec * 1000 end as spot, list_filter({_LIST.replace('kind', 'm.kind', 1)}, lambda f: not list_contains(list_transform(p.picks, lambda x: x.fx), f)) as fresh
    from {{prev}} p join moments m on m.video_id = p.video_id where p.left_ >= 300 and (m.kind <> 'opening' or p.i = 0)
      and len(list_filter(p.picks, lambda x: abs(m.sec * 1000 - x.s) < 2500)) = 0) where len(fresh) > 0)))
    where stop - spot >= 300 and stop - spot <= left_) where rn = 1"""


def _plan_sql(src: str) -> dict[str, str]:
    steps = {"p0": "select video_id, seconds, 0 as i, cast([] as struct(s bigint, e bigint, fx varchar, kind varchar)[]) as picks, seconds * 100.0 as left_ from clips where seconds >= 2"}
    for k in (1, 2, 3):
        steps[f"p{k}"] = _NEXT.replace("{prev}", f"p{k - 1}")
    return {"med": _MED.format(src=src), "clips": _CLIPS, "raw": _MOMENT.format(src=src),
            "moments": """select r.* from raw r join clips c using (video_id) where not c.flat or r.kind = 'join' union all
               select video_id, 0, 0.0, 'opening' from clips where opening and seconds >= 3""",
            **steps, "plan": "select video_id, unnest(picks) as x from (select *, max(i) over (partition by video_id) as top from (select * from p1 union all select * from p2 union all select * from p3)) where i = top"}


_ENDS = {"ends": "select video_id, end_ms as at_ms from sentences"}
_COARSE = {"coarse": "select video_id, sec // 4 as sec, max(rms) as rms, least(100, max(motion)) as motion from signal group by all",
           "ends": "select video_id, end_ms // 4 as at_ms from sentences"}
_SHARE = """select video_id, cast(coalesce(n, 0) as bigint) as n_effects, cast(coalesce(ms, 0) as bigint) as effect_ms, round(coalesce(ms, 0) / (seconds * 10), 4) as percent
    from clips left join (select video_id, count(*) as n, sum(x.e - x.s) as ms from plan group by 1) using (video_id)"""


def _planned(series, joins):
    """(plan, clips) of a series; `joins`: keys, at_ms."""
    moments = sg.surprise(series, KEY, CHUNK)
    near = (joins.select(*KEY, F.explode(F.sequence(F.ceil((F.col("at_ms") - 600) / 1000), F.floor((F.col("at_ms") + 600) / 1000))).alias("sec"))
            .distinct().withColumn("at_join", F.lit(True)))
    kind = sg.moment_kind(F.col("rms"), F.col("motion"), F.col("med_rms"), F.col("med_motion"), F.col("sec"), F.col("last_sec") + 1, F.coalesce("at_join", F.lit(False)))
    ranked = moments.join(near, [*KEY, "sec"], "left").select(*KEY, "sec", F.round("score", 4).alias("score"), kind.alias("kind"))

    def span(top, med):
        return F.when((F.col("n") < 3) | (F.col(med) <= 0), 0.0).otherwise(F.col(top) / F.col(med))
    clips = checkpointed(sg.medians(series, KEY).select(
        *KEY, (F.col("last_sec") + 1).alias("seconds"), ef.is_flat(span("max_rms", "med_rms"), span("max_motion", "med_motion")).alias("flat"),
        (F.col("video_id") % 2 == 0).alias("opening")))
    return ef.pick_effects(ranked, clips, KEY), clips


def _raw_plan(spark, folder):
    return _planned(signal(spark, folder), sentences(spark, folder).select("video_id", F.col("end_ms").alias("at_ms")))


@query(with_tables("select video_id, x.s as start_ms, x.e as end_ms, x.fx as effect, x.kind as kind from plan", "signal", "sentences", more=_ENDS | _plan_sql("signal")))
def pick_effects(spark, folder):
    return _raw_plan(spark, folder)[0]


@query(with_tables(_SHARE, "signal", "sentences", more=_ENDS | _plan_sql("signal")))
def effect_coverage(spark, folder):
    plan, clips = _raw_plan(spark, folder)
    return ef.effect_coverage(plan, clips, KEY)


@query(with_tables("""select video_id, n_effects, effect_ms, percent, coalesce(told, '') as told from share left join (select video_id, string_agg(x.s || ' ' || x.fx, ', ' order by x.s) as told from plan group by 1) using (video_id)""",
                   "signal", "sentences", more=_COARSE | _plan_sql("coarse") | {"share": _SHARE}))
def effect_plan(spark, folder):
    """The whole job from the rolled-up signal: moments, kinds, flatness, choice, share."""
    series = signal(spark, folder).groupBy(*KEY, F.floor(F.col("sec") / 4).alias("sec")).agg(F.max("rms").alias("rms"), F.least(F.lit(100), F.max("motion")).alias("motion"))
    plan, clips = _planned(series, sentences(spark, folder).select("video_id", F.floor(F.col("end_ms") / 4).alias("at_ms")))
    plan = checkpointed(plan)
    told = plan.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "effect"))),
                                                           lambda x: F.concat(x["start_ms"].cast("string"), F.lit(" "), x["effect"])), ", ").alias("told"))
    return (ef.effect_coverage(plan, clips, KEY).join(told, KEY, "left").withColumn("told", F.coalesce("told", F.lit(""))))
