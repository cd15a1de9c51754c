"""Script rewriting queries: a line of a document is a part, and lines of a length divisible by three keep the original sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import rewrites as rw
from reelgrid.plans.registry import query
from reelgrid.sources.standins import doc_lines, with_tables

KEY = ["video_id"]
_SCRIPT = {"script": """select video_id, start_ms, end_ms, case when length(text) % 3 = 0 then 'orig' else 'narrate' end as mode,
    idx % 8 = 7 as wall, length(text) % 2 = 0 as told from doc_lines"""}
_PARTS = "select video_id, list({{'s': start_ms, 'e': end_ms, 'm': mode, 'k': {mark}}} order by start_ms) as p from script group by 1"
_OUT = "select video_id, x.s as start_ms, x.e as end_ms, x.m as mode from (select video_id, unnest(p) as x from {src})"
#: Original parts that follow each other at once become one.
_JOINED = """select video_id, min(s) as start_ms, max(e) as end_ms, min(m) as mode from (select *, sum(brk) over (partition by video_id order by s rows unbounded preceding) as run from (
    select video_id, x.s as s, x.e as e, x.m as m, case when x.m = 'orig' and lag(x.m) over w = 'orig' and abs(x.s - lag(x.e) over w) < 300 then 0 else 1 end as brk
    from (select video_id, unnest(p) as x from {src}) window w as (partition by video_id order by x.s))) group by video_id, run"""


def script(spark, folder):
    size = F.length("text")
    return doc_lines(spark, folder).select("video_id", "start_ms", "end_ms", F.when(size % 3 == 0, "orig").otherwise("narrate").alias("mode"),
                                           (F.col("idx") % 8 == 7).alias("wall"), (size % 2 == 0).alias("told"))


@query(with_tables(_OUT.format(src="walk where done"), "doc_lines", more=_SCRIPT | {
    "walk": _PARTS.format(mark="wall").replace("as p from", "as p, false as done from") + """ union all
      select video_id, case when i is null then p when p[i].e - p[i].s <= p[i + 1].e - p[i + 1].s
          then p[1:i - 1] || [{'s': p[i].s, 'e': p[i + 1].e, 'm': p[i + 1].m, 'k': p[i + 1].k}] || p[i + 2:]
          else p[1:i - 1] || [{'s': p[i].s, 'e': p[i + 1].e, 'm': p[i].m, 'k': p[i + 1].k}] || p[i + 2:] end, i is null
      from (select *, list_filter(cand, lambda j: least(p[j].e - p[j].s, p[j + 1].e - p[j + 1].s) = low)[1] as i from (
        select *, list_min(list_transform(cand, lambda j: least(p[j].e - p[j].s, p[j + 1].e - p[j + 1].s))) as low from (
        select *, case when len(list_filter(generate_series(1, len(p) - 1), lambda j: p[j].m <> p[j + 1].m)) <= 8 then [] else
          list_filter(generate_series(1, len(p) - 1), lambda j: p[j].m <> p[j + 1].m and not p[j].k and not (j = 1 and p[1].e - p[1].s <= p[2].e - p[2].s)
          and not (n_orig <= 1 and (case when p[j].e - p[j].s <= p[j + 1].e - p[j + 1].s then p[j].m else p[j + 1].m end) = 'orig')) end as cand
        from (select video_id, p, len(list_filter(p, lambda x: x.m = 'orig')) as n_orig from walk where not done))))"""}).replace("walk as materialized", "walk as"))
def limit_role_changes(spark, folder):
    return rw.limit_role_changes(script(spark, folder), KEY, barrier="wall")


@query(with_tables(_JOINED.format(src="walk where phase = 4"), "doc_lines", more=_SCRIPT | {
    "clean": """select video_id, min(start_ms) as start_ms, max(end_ms) as end_ms, min(mode) as mode, min(case when rn = 1 then told end) as told from (
       select *, row_number() over (partition by video_id, run order by start_ms) as rn from (select *, sum(brk) over (partition by video_id order by start_ms rows unbounded preceding) as run from (
       select *, case when mode = 'orig' and lag(mode) over (partition by video_id order by start_ms) = 'orig' then 0 else 1 end as brk from script))) group by video_id, run""",
    "walk": _PARTS.format(mark="told").replace("from script", "from clean").replace("as p from", "as p, 1 as phase, cast([] as bigint[]) as out from") + """ union all
      select video_id, case
          when phase = 1 and i is not null and early then p[1:i - 2] || [{'s': p[i - 1].s, 'e': p[i].e, 'm': 'narrate', 'k': p[i - 1].k}] || p[i + 1:]
          when phase = 1 and i is not null then p[1:i - 1] || [{'s': p[i].s, 'e': p[i + 1].e, 'm': 'narrate', 'k': p[i + 1].k}] || p[i + 2:]
          when phase = 2 and i is not null then p[1:i - 2] || [{'s': p[i - 1].s, 'e': p[i + 1].e, 'm': 'orig', 'k': p[i - 1].k}] || p[i + 2:]
          when phase = 3 and i is not null and p[i].k then p[1:i - 1] || [{'s': p[i].s, 'e': p[i].e, 'm': 'narrate', 'k': p[i].k}] || p[i + 1:]
          when phase = 3 and i is not null and taken and early then p[1:i - 2] || [{'s': p[i - 1].s, 'e': p[i].e, 'm': 'narrate', 'k': p[i - 1].k}] || p[i + 1:]
          when phase = 3 and i is not null and taken then p[1:i - 1] || [{'s': p[i].s, 'e': p[i + 1].e, 'm': 'narrate', 'k': p[i + 1].k}] || p[i + 2:]
          else p end,
        case when i is null then phase + 1 else phase end,
        case when phase = 2 and i is null then (list_reverse_sort(list_transform(list_sort(list_transform(origs, lambda j: {'d': -(p[j].e - p[j].s), 'j': j}))[3:], lambda x: p[x.j].s)))
             when phase = 3 and i is not null then out[2:] else out end
      from (select *, before_ and (not after_ or p[i - 1].e - p[i - 1].s >= p[i + 1].e - p[i + 1].s) as early, before_ or after_ as taken from (
        select *, i > 1 and p[i - 1].m = 'narrate' as before_, i < len(p) and p[i + 1].m = 'narrate' as after_ from (
        select *, case phase
          when 1 then case when len(origs) > 1 then list_sort(list_transform(list_filter(origs, lambda j: p[j].e - p[j].s < 3000
              and ((j > 1 and p[greatest(j - 1, 1)].m = 'narrate') or (j < len(p) and p[least(j + 1, len(p))].m = 'narrate'))), lambda j: {'d': p[j].e - p[j].s, 'j': j}))[1].j end
          when 2 then list_filter(generate_series(2, len(p) - 1), lambda j: p[j].m = 'narrate' and p[j].e - p[j].s < 6000 and p[j - 1].m = 'orig' and p[j + 1].m = 'orig')[1]
          when 3 then case when len(out) > 0 then list_filter(origs, lambda j: p[j].s = out[1])[1] end end as i
        from (select *, list_filter(generate_series(1, len(p)), lambda j: p[j].m = 'orig') as origs from walk where phase < 4))))"""}).replace("walk as materialized", "walk as"))
def fix_structure(spark, folder):
    # parts reach this rule with neighbouring original parts already joined; the words of the first of them count
    clean = rw.rewrite(script(spark, folder), KEY, rw.joined_orig).join(script(spark, folder).select("video_id", "start_ms", "told"), ["video_id", "start_ms"])
    return rw.fix_structure(clean, KEY, told="told")


@query(with_tables(_JOINED.format(src="walk where done"), "doc_lines", more=_SCRIPT | {
    "walk": _PARTS.format(mark="told").replace("as p from", "as p, false as done from") + """ union all
      select video_id, case when i is null then p else p[1:i - 1] || [{'s': p[i].s, 'e': p[i].e, 'm': 'orig', 'k': p[i].k}] || p[i + 1:] end, i is null
      from (select *, case when 100 * cur > 57 * total and len(narr) > 2 then list_sort(list_filter(list_transform(narr[2:len(narr) - 1],
          lambda j: {'gap': abs(100 * (cur - (p[j].e - p[j].s)) - 45 * total), 'j': j}), lambda x: x.gap < abs(100 * cur - 45 * total)))[1].j end as i from (
        select *, coalesce(list_sum(list_transform(p, lambda x: x.e - x.s)), 0)::bigint as total, coalesce(list_sum(list_transform(list_filter(p, lambda x: x.m = 'narrate'), lambda x: x.e - x.s)), 0)::bigint as cur,
          list_filter(generate_series(1, len(p)), lambda j: p[j].m = 'narrate') as narr from walk where not done))"""}).replace("walk as materialized", "walk as"))
def enforce_ratio(spark, folder):
    return rw.enforce_ratio(script(spark, folder), KEY)
