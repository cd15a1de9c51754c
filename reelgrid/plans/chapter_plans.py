"""Chapter queries: cutting a video into chapters, joining thin ones, allotting footage and fitting lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import chapters as ch, intervals as iv, transcripts as tr
from reelgrid.plans.interval_sets import merged_cte
from reelgrid.plans.registry import query
from reelgrid.session import checkpointed
from reelgrid.sources.standins import doc_lines, with_tables
from reelgrid.sources.tables import read_table
from reelgrid.plans.transcript_jobs import _LINES as _SCORED

KEY, CHUNK, BUCKET = ["video_id"], 600_000, 60_000
SLICE = 20_000                     # width of the equal slices that sparse chapters are made of
ACT = 400_000                      # width of a chapter of footage


# ---- cutting and joining, over the lines of documents ----
_VIDEOS = {"v": """select video_id, d, n, greatest(1, least(8, n // 4, d // 40000)) as k, mids from (
    select video_id, max(end_ms) as d, count(*) as n, list(start_ms + end_ms order by start_ms + end_ms) as mids from doc_lines group by 1)"""}


@query(with_tables("""select video_id, cast(i as bigint) as chapter, cast(c0 as bigint) as c0, cast(c1 as bigint) as c1 from long union all
    select video_id, 1, 0, d from v where video_id not in (select video_id from long)""", "doc_lines", more=_VIDEOS | {
    "raws": """select video_id, i, d, case when n >= k then (mids[spot] + mids[spot + 1]) // 4 else d * i // k end as raw from (
       select *, greatest(1, least(n - 1, cast(round_even(n * i / k, 0) as bigint))) as spot from (select *, unnest(generate_series(1, k - 1)) as i from v where k > 1))""",
    "cuts": """select r.video_id, r.i, r.d, r.raw, coalesce(min(e.edge_ms), r.raw) as near from (
       select r.*, (select min(abs(e.edge_ms - r.raw)) from edges e where e.video_id = r.video_id and abs(e.edge_ms - r.raw) <= 15000) as best from raws r) r
       left join edges e on e.video_id = r.video_id and abs(e.edge_ms - raw) = best group by r.video_id, r.i, r.d, r.raw""",
    "bounds": """select video_id, cast(0 as bigint) as i, cast(0 as bigint) as t from v union all
       select b.video_id, b.i + 1, case when c.near - b.t >= 20000 and c.d - c.near >= 20000 then c.near else c.raw end from bounds b join cuts c on c.video_id = b.video_id and c.i = b.i + 1""",
    "spans": """select video_id, i, c0, t as c1 from (select *, lag(t) over (partition by video_id order by i) as c0 from (
       select * from bounds union all select video_id, k, d from v)) where i > 0""",
    "long": "select * from spans where c1 - c0 >= 20000"}).replace("raws as materialized", "edges as materialized (select distinct video_id, unnest([start_ms, end_ms]) as edge_ms from doc_lines),\nraws as materialized")
    .replace("bounds as materialized", "bounds as"))
def split_chapters(spark, folder):
    s = doc_lines(spark, folder)
    videos = (s.groupBy("video_id").agg(F.max("end_ms").alias("duration"), F.count("*").alias("n"))
              .select("video_id", "duration", F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("n") / 4), F.floor(F.col("duration") / 40_000))).cast("long").alias("k")))
    return ch.split_chapters(s, videos, KEY, CHUNK)


@query(with_tables("""select video_id, unnest(chs).c0 as c0, unnest(chs).c1 as c1 from joined where done""", "doc_lines", more={
    "v": """select video_id, max(end_ms) as d, list(start_ms + end_ms) as mids, greatest(1, max(end_ms) // 20000) as m from doc_lines group by 1""",
    "start_": """select video_id, mids, greatest(1, m // 4) as keep, list_transform(generate_series(0, m - 1), lambda j: {'c0': j * 20000, 'c1': case when j = m - 1 then d else (j + 1) * 20000 end}) as chs from v""",
    "joined": """select video_id, mids, keep, chs, false as done from start_ union all
      select video_id, mids, keep, case when i is null then chs when to_left then chs[1:i - 2] || [{'c0': chs[i - 1].c0, 'c1': chs[i].c1}] || chs[i + 1:]
        else chs[1:i - 1] || [{'c0': chs[i].c0, 'c1': chs[i + 1].c1}] || chs[i + 2:] end, i is null
      from (select *, i > 1 and (i = len(chs) or cnt[i - 1] <= cnt[i + 1]) as to_left from (
        select *, case when len(chs) > keep then list_position(list_transform(cnt, lambda x: x < 3), true) end as i from (
        select *, list_transform(chs, lambda c: len(list_filter(mids, lambda x: x >= 2 * (c.c0 - 10) and x <= 2 * (c.c1 + 10)))) as cnt from joined where not done)))"""})
    .replace("joined as materialized", "joined as"))
def merge_sparse_chapters(spark, folder):
    s = doc_lines(spark, folder)
    v = s.groupBy("video_id").agg(F.max("end_ms").alias("d")).withColumn("m", F.greatest(F.lit(1), F.floor(F.col("d") / SLICE)).cast("long"))
    j = F.col("j")
    slices = (v.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
              .select("video_id", (j * SLICE).alias("c0"), F.when(j == F.col("m") - 1, F.col("d")).otherwise((j + 1) * SLICE).alias("c1"),
                      F.greatest(F.lit(1), F.floor(F.col("m") / 4)).cast("long").alias("min_keep")))
    return ch.merge_sparse_chapters(slices, s, KEY, CHUNK)


# ---- footage: a part is a video, a day one second, a returned item was used before ----
_FOOT = {"foot": """select l_partkey as video_id, cast(l_linenumber as bigint) as lane, s_ms, s_ms + cast(l_quantity as bigint) * 1000 as e_ms, l_returnflag as flag from (
    select *, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) * 1000 as s_ms from lineitem)"""}


def footage(spark, folder):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return read_table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("lane"), (day * 1000).alias("s_ms"),
        (day * 1000 + F.col("l_quantity").cast("long") * 1000).alias("e_ms"), F.col("l_returnflag").alias("flag"))


def _used(foot):
    return foot.filter("flag = 'A'").select("video_id", F.col("s_ms").alias("us"), F.col("e_ms").alias("ue"))


@query(with_tables("select video_id, c as lane, unnest(pieces).s as s_ms, unnest(pieces).e as e_ms from pass where c > 0", more=_FOOT | {
    "wide": "select video_id * 10 + lane as video_id, s_ms, e_ms from foot where flag = 'N'",
    "own": merged_cte("wide", "own"),
    "wins": "select video_id // 10 as video_id, video_id % 10 as lane, list({'s': s_ms, 'e': e_ms}) as ws from own group by all",
    "a": "select * from foot where flag = 'A'", "u": merged_cte("a", "u"),
    "seed": "select w.video_id, coalesce(first(s.b), []) as b from (select distinct video_id from wins) w left join (select video_id, list({'s': s_ms - 500, 'e': e_ms + 500} order by s_ms) as b from u group by 1) s using (video_id) group by 1",
    "pass": """select video_id, cast(0 as bigint) as c, b as blk, cast([] as struct(s bigint, e bigint)[]) as pieces from seed union all
      select video_id, c + 1, list_sort(blk || list_transform(found, lambda p: {'s': p.s - 500, 'e': p.e + 500})), found from (
        select p.video_id, p.c, p.blk, flatten(list_transform(coalesce(w.ws, []), lambda x: list_filter(list_transform(generate_series(0, len(p.blk)), lambda i:
          {'s': greatest(x.s, case when i = 0 then -1000000000000 else p.blk[i].e end), 'e': least(x.e, case when i = len(p.blk) then 1000000000000 else p.blk[i + 1].s end)}),
          lambda q: q.e - q.s >= 3000))) as found
        from pass p left join wins w on w.video_id = p.video_id and w.lane = p.c + 1 where p.c < 7)"""}).replace("pass as materialized", "pass as"))
def used_pass(spark, folder):
    f = footage(spark, folder)
    return ch.used_pass(f.filter("flag = 'N'").select("video_id", "lane", "s_ms", "e_ms"), _used(f), KEY, "lane", CHUNK, BUCKET)


_FIT = _FOOT | {
    "act": "select video_id * 1000 + s_ms // 400000 as video_id, s_ms, least(e_ms, (s_ms // 400000 + 1) * 400000) as e_ms from foot where flag = 'N'",
    "own": merged_cte("act", "own"),
    "a": "select * from foot where flag = 'A'", "u": merged_cte("a", "u"),
    "blk": "select video_id, s_ms - 500 as bs, e_ms + 500 as be from u",
    "free": """select video_id, lead(bs, 1, 1000000000000) over (partition by video_id order by bs) as fe, be as fs from blk union all
       select video_id, min(bs), -1000000000000 from blk group by 1 union all select distinct video_id, 1000000000000, -1000000000000 from foot where video_id not in (select video_id from blk)""",
    "win": """select o.video_id // 1000 as video_id, o.video_id % 1000 as act, greatest(s_ms, fs) as s_ms, least(e_ms, fe) as e_ms from own o join free f on f.video_id = o.video_id // 1000
       where least(e_ms, fe) - greatest(s_ms, fs) >= 3000""",
    "edges": "select distinct video_id, unnest([s_ms, e_ms]) as t from foot where flag = 'R'",
    "dur": "select video_id, max(e_ms) as dur from foot group by 1",
    "seen": """select *, sum(e_ms - s_ms) over (partition by video_id, act) as whole, coalesce(sum(e_ms - s_ms) over (partition by video_id, act order by s_ms rows between unbounded preceding and 1 preceding), 0) as before from win""",
    "cut": """select *, coalesce((select min(t) from edges e where e.video_id = s.video_id and t between s.s_ms + 80000 - before - 2000 and s.s_ms + 80000 - before + 50), s_ms + 80000 - before) as ne from seen s""",
    "kept": """select video_id, act, s_ms, case when whole > 81000 and before + e_ms - s_ms > 80000 then ne else e_ms end as e_ms, whole > 81000 as over from cut
       where whole <= 81000 or (before < 79990 and (before + e_ms - s_ms <= 80000 or ne - s_ms >= 3000))""",
    "rows_": """select video_id, act, min(s_ms) as fs, max(e_ms) as le, sum(e_ms - s_ms) as tot, bool_or(over) as over from (
       select * from kept union all select video_id, act, s_ms, e_ms, true from cut c where before = 0 and whole > 81000 and not exists (select 1 from kept k where k.video_id = c.video_id and k.act = c.act)) group by all""",
    "r0": """select r.*, act * 400000 as c0, (act + 1) * 400000 as c1, dur, (select min(bs) from blk b where b.video_id = r.video_id and bs >= le) as wall,
       (select max(be) from blk b where b.video_id = r.video_id and be <= fs) as flo, tot < 59000 as asked from rows_ r join dur using (video_id)""",
    "r1": """select *, greatest(le, least(c1, coalesce(wall, c1))) as stop, case when asked then greatest(0, least(greatest(le, least(c1, coalesce(wall, c1))) - le, 60000 - tot)) else 0 end as ad from r0""",
    "r2": """select * replace (le + g as le, tot + g as tot) from (select *, case when ad > 50 then least(stop, coalesce((select max(t) from edges e where e.video_id = r.video_id and t between le + ad - 50 and le + ad + 3000), le + ad)) - le else 0 end as g from r1 r)""",
    "r3": """select * exclude (stop, ad, g), least(fs, greatest(c0, coalesce(flo, c0))) as stop, case when asked and 60000 - tot > 500 then greatest(0, least(fs - least(fs, greatest(c0, coalesce(flo, c0))), 60000 - tot)) else 0 end as ad from r2""",
    "r4": """select * replace (fs - g as fs, tot + g as tot) from (select *, case when ad > 50 then fs - greatest(stop, coalesce((select min(t) from edges e where e.video_id = r.video_id and t between fs - ad - 3000 and fs - ad + 50), fs - ad)) else 0 end as g from r3 r)""",
    "r5": """select * exclude (stop, ad, g), greatest(le, least(dur, coalesce(wall, dur))) as stop, case when asked and 60000 - tot > 500 then greatest(0, least(greatest(le, least(dur, coalesce(wall, dur))) - le, 60000 - tot)) else 0 end as ad from r4""",
    "r6": """select * replace (le + g as le, tot + g as tot) from (select *, case when ad > 50 then least(stop, coalesce((select max(t) from edges e where e.video_id = r.video_id and t between le + ad - 50 and le + ad + 3000), le + ad)) - le else 0 end as g from r5 r)"""}


@query(with_tables("""select video_id, act, cast(fs as bigint) as first_s, cast(le as bigint) as last_e, cast(tot as bigint) as total,
    case when over then 'cut' when not asked then 'kept' when tot < 59000 then 'short' else 'stretched' end as reason from r6""", more=_FIT))
def fit_chapters(spark, folder):
    f = footage(spark, folder)
    act = F.floor(F.col("s_ms") / ACT)
    new = f.filter("flag = 'N'").withColumn("act", act).withColumn("e_ms", F.least(F.col("e_ms"), (F.col("act") + 1) * ACT))
    own = iv.merge_ranges(new, [*KEY, "act"], "s_ms", "e_ms", CHUNK)
    free = checkpointed(iv.subtract_ranges(checkpointed(own), _used(f), KEY, "s_ms", "e_ms", "us", "ue", CHUNK, BUCKET, walls=True)
                        .select("video_id", "act", F.col("piece_s").alias("s_ms"), F.col("piece_e").alias("e_ms"), "floor", "wall"))
    ends = f.groupBy("video_id").agg(F.max("e_ms").alias("duration"))
    acts = (free.select("video_id", "act").distinct().join(ends, "video_id")
            .select("video_id", "act", (F.col("act") * ACT).alias("c0"), ((F.col("act") + 1) * ACT).alias("c1"), "duration"))
    edges = f.filter("flag = 'R'").select("video_id", F.explode(F.array("s_ms", "e_ms")).alias("edge_ms"))
    return ch.fit_chapters(free, acts, _used(f), edges, KEY, "act", 60_000, 80_000, CHUNK, BUCKET)


# ---- windows as a model gives them: one from each line on, of any length, some beyond the video ----
_RAW = {"raw": "select video_id, idx % 3 as script, start_ms - 700 as s_ms, start_ms + 5000 + length(text) * 397 % 60000 as e_ms from doc_lines",
        "dur": "select video_id, max(end_ms) as d from doc_lines group by 1",
        "cl": """select * from (select video_id, script, s, least(e, s + 45000) as e from (select r.video_id, script, least(greatest(s_ms, 0), d) as s, least(e_ms, d) as e from raw r join dur using (video_id)))
           where e - s >= 6000""",
        "ord": "select *, row_number() over (partition by video_id, script order by s, e) as rn from cl",
        "walk": """select video_id, script, rn, s as a, e as b, true as keep, e as top from ord where rn = 1 union all
           select o.video_id, o.script, o.rn, greatest(o.s, w.top), o.e, o.e - greatest(o.s, w.top) >= 6000, case when o.e - greatest(o.s, w.top) >= 6000 then o.e else w.top end
           from walk w join ord o on o.video_id = w.video_id and o.script = w.script and o.rn = w.rn + 1""",
        "win": "select video_id, script, a, b, count(*) over (partition by video_id, script) as n from walk where keep",
        "said": """select w.video_id, w.script, w.a, w.b, w.n, round(coalesce(sum(case when m.cta or m.greeting or m.promo then n_words else 0 end) / nullif(sum(n_words), 0), 0), 6) as junk_ratio,
           round(coalesce(sum(n_words * (least(w.b, m.end_ms) - greatest(w.a, m.start_ms)) / greatest(1, m.end_ms - m.start_ms)), 0) * 1000 / (w.b - w.a), 6) as density
           from win w left join mk m on m.video_id = w.video_id and m.end_ms > w.a and m.start_ms < w.b group by w.video_id, w.script, w.a, w.b, w.n""",
        "good": """select *, row_number() over (partition by video_id, script order by b - a desc, a) as place from said where junk_ratio <= 0.3 and (density >= 1.2 or n <= 1)""",
        "upto": "select *, coalesce(sum(b - a) over (partition by video_id, script order by a rows between unbounded preceding and 1 preceding), 0) as before from good where place <= 6",
        "fit": "select * from (select video_id, script, a, least(b, a + 90000 - before) as b from upto where before < 89990) where b - a >= 6000"}


@query(with_tables("""select video_id, cast(script as bigint) as script, cast(a as bigint) as s_ms, cast(b as bigint) as e_ms from (select *, count(*) over w as n, sum(b - a) over w as total from fit window w as (partition by video_id, script))
    where total >= case when n = 1 then 24000 else 24000 end""", "doc_lines", more=_SCORED | _RAW).replace("walk as materialized", "walk as"))
def validate_windows(spark, folder):
    d = doc_lines(spark, folder)
    raw = d.select("video_id", (F.col("idx") % 3).alias("script"), (F.col("start_ms") - 700).alias("s_ms"),
                   (F.col("start_ms") + 5000 + F.length("text") * 397 % 60_000).alias("e_ms"))
    ends = d.groupBy("video_id").agg(F.max("end_ms").alias("duration"))
    return ch.validate_windows(raw, ends, tr.scored_sentences(d, KEY), KEY, "script", CHUNK, BUCKET, 40_000, 90_000)
