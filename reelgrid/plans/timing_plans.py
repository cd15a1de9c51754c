"""Timing queries: packed lines, words dealt to speech, teasers, and part ends at natural places."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import coupled as cp, cues as cu, packing as pk, signals as sg
from reelgrid.plans.registry import query
from reelgrid.sources.standins import doc_lines, sentences, signal, with_tables, words
from reelgrid.sources.tables import read_texts

KEY, CHUNK, BUCKET = ["video_id"], 600_000, 60_000

# ---- lines of ten seconds where a document lasts over eight minutes, one for each sentence elsewhere ----
_LINES = {
    "l": """select *, row_number() over (partition by video_id order by start_ms, idx) as i, max(end_ms) over (partition by video_id order by start_ms, idx) as latest
       from (select *, case when max(end_ms) over (partition by video_id) > 480000 then 10000 else 0 end as step from doc_lines)""",
    "walk": """select video_id, i, i as bin, start_ms as s, latest, latest - start_ms >= step as shut, trim(text) as told from l where i = 1 union all
       select l.video_id, l.i, case when w.shut then l.i else w.bin end, case when w.shut then l.start_ms else w.s end, l.latest,
         l.latest - case when w.shut then l.start_ms else w.s end >= l.step, trim(l.text) from walk w join l on l.video_id = w.video_id and l.i = w.i + 1"""}


@query(with_tables("select video_id, bin as line, min(s) as start_ms, max(latest) as end_ms, string_agg(told, ' ' order by i) as text from walk group by 1, 2",
                   "doc_lines", more=_LINES).replace("walk as materialized", "walk as"))
def condense_lines(spark, folder):
    d = doc_lines(spark, folder)
    long = d.groupBy("video_id").agg(F.when(F.max("end_ms") > 480_000, 10_000).otherwise(0).alias("step"))
    return pk.condense_lines(d, KEY, CHUNK, F.col("step"), long)


@query(with_tables("select video_id, min(idx) as first_idx, count(*) as n_lines, cast(sum(n) as bigint) as chars from walk group by video_id, bin", "doc_lines", more={
    "l": "select *, length(text) as n, row_number() over (partition by video_id order by idx) as i from doc_lines",
    "walk": """select video_id, idx, n, i, i as bin, n + 1 as used from l where i = 1 union all
       select l.video_id, l.idx, l.n, l.i, case when w.used + l.n > 600 then l.i else w.bin end, case when w.used + l.n > 600 then l.n + 1 else w.used + l.n + 1 end
       from walk w join l on l.video_id = w.video_id and l.i = w.i + 1"""}).replace("walk as materialized", "walk as"))
def char_chunks(spark, folder):
    d = doc_lines(spark, folder).select("video_id", "idx", F.length("text").alias("n"))
    return (pk.char_chunks(d, KEY, ["idx"], F.floor(F.col("idx") / 512), 600, F.col("n")).groupBy("video_id", "bin")
            .agg(F.min("idx").alias("first_idx"), F.count("*").alias("n_lines"), F.sum("n").alias("chars")).drop("bin"))


# ---- words of a document dealt to its lines, as if each line were a stretch of speech with a pause before it ----
@query(with_tables("""select video_id, cast(grp as bigint) as grp, text, cast(s_ms + (e_ms - s_ms) * (seen - n) // every as bigint) as a, cast(s_ms + (e_ms - s_ms) * seen // every as bigint) as b from (
    select *, sum(n) over (partition by video_id, isl order by grp) as seen, sum(n) over (partition by video_id, isl) as every from (
    select g.video_id, g.grp, g.text, length(g.text) as n, s.isl, s.s_ms, s.e_ms from g join spans s on s.video_id = g.video_id and g.grp >= s.lo and g.grp < s.upto))""", "doc_lines", more={
    "isl": "select video_id, idx as isl, start_ms + (idx % 3) * 100 as s_ms, end_ms as e_ms from doc_lines",
    "t": "select doc_id as video_id, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as w from documents",
    "g": """select video_id, grp, array_to_string(w[grp * 4 + 1:grp * 4 + 4], ' ') as text from (select video_id, w, unnest(generate_series(0, (len(w) + 3) // 4 - 1)) as grp from t where len(w) > 0)""",
    "asked": """select *, part // total as whole, part % total as over from (select *, d * groups as part, sum(d) over (partition by video_id) as total from (
       select i.*, greatest(10, e_ms - s_ms) as d, (len(w) + 3) // 4 as groups from isl i join t using (video_id) where len(w) > 0))""",
    "spans": """select *, sum(n) over (partition by video_id order by isl) as upto, sum(n) over (partition by video_id order by isl) - n as lo from (
       select *, whole + case when row_number() over (partition by video_id order by over desc, isl) <= groups - sum(whole) over (partition by video_id) then 1 else 0 end as n from asked)"""}))
def deal_to_islands(spark, folder):
    isl = doc_lines(spark, folder).select("video_id", F.col("idx").alias("isl"), (F.col("start_ms") + (F.col("idx") % 3) * 100).alias("s_ms"), F.col("end_ms").alias("e_ms"))
    texts = read_texts(spark, folder, "documents").select(F.col("doc_id").alias("video_id"), "text")
    return cu.deal_to_islands(texts, isl, KEY)


@query(with_tables("""select video_id, turn, cast((nth - 1) // 3 as bigint) as grp, string_agg(word, ' ' order by nth) as text, min(start_ms) as a, max(end_ms) as b
    from (select *, row_number() over (partition by video_id, turn order by pos) as nth from words) group by 1, 2, 3""", "words"))
def phrase_groups_heard(spark, folder):
    return cu.phrase_groups_heard(words(spark, folder), ["video_id", "turn"], ["pos"], F.floor(F.col("pos") / 512))


# ---- teasers: a conversation is one clip, its turns are the segments; every third clip brings a hook along ----
@query(with_tables("""select video_id, clip_id, case when given and keeps then hook_s when not given and abs(best - first_s) > 3000 then best end as hook_s,
    case when given and keeps then least(hook_e, hook_s + 4000) when not given and abs(best - first_s) > 3000 then best + 2500 end as hook_e from (
    select c.*, hook_s is not null as given, hook_e - hook_s >= 1000 and abs(hook_s - first_s) > 3000 as keeps, b.best from clips c left join best b using (video_id))""", "sentences", "signal", more={
    "clips": """select video_id, cast(0 as bigint) as clip_id, min(start_ms) as first_s, case when video_id % 3 = 0 then max(start_ms) end as hook_s, case when video_id % 3 = 0 then max(start_ms) + 900 + video_id * 50 end as hook_e
       from sentences group by 1""",
    "win": """select video_id, idx, k, start_ms + k * 1000 as t from (select *, unnest(generate_series(0, (end_ms - start_ms - 2500) // 1000)) as k from sentences where end_ms - start_ms >= 2500)""",
    "best": """select video_id, arg_min(t, {'s': -score, 'i': idx, 'k': k}) as best from (
       select w.video_id, w.idx, w.k, w.t, case when count(s.rms) = 0 then 0.0 else round(least(100, (6 * sum(s.rms) / count(s.rms) + 4 * max(s.rms)) / 100), 4) end as score
       from win w left join signal s on s.video_id = w.video_id and s.sec >= w.t // 1000 and s.sec < (w.t + 2500) // 1000 group by all) group by 1"""}))
def fallback_hook(spark, folder):
    s = sentences(spark, folder).withColumn("clip_id", F.lit(0).cast("long"))
    segs = s.select("video_id", "clip_id", F.col("idx").alias("seg_idx"), F.col("start_ms").alias("s_ms"), F.col("end_ms").alias("e_ms"))
    third = F.col("video_id") % 3 == 0
    clips = s.groupBy("video_id", "clip_id").agg(F.max("start_ms").alias("last")).select(
        "video_id", "clip_id", F.when(third, F.col("last")).alias("hook_s"), F.when(third, F.col("last") + 900 + F.col("video_id") * 50).alias("hook_e"))
    return sg.fallback_hook(signal(spark, folder), segs, clips, KEY, ["clip_id"], 600, 60)


# ---- part ends: edges and cuts lie beside and inside the words of a conversation ----
_NEAR = "(select {c} from {t} e where e.video_id = q.video_id and abs({c} - t) <= {tol} order by abs({c} - t), {c} limit 1)"


@query(with_tables("select video_id, idx, start_ms, end_ms, mode from (select *, coalesce(lag(fin) over (partition by video_id order by idx), opening) as start_ms, fin as end_ms from done)", "sentences", "words", more={
    "parts": "select video_id, idx, start_ms as s, end_ms as e, case when role = 'assistant' then 'narrate' else 'orig' end as mode, row_number() over (partition by video_id order by idx) as rn, count(*) over (partition by video_id) as n from sentences",
    "edges": "select distinct video_id, start_ms + 120 as edge_ms from words where pos % 9 = 4",
    "cuts": "select distinct video_id, end_ms + 60 as cut_ms from words where pos % 13 = 6",
    "q": """select p.video_id, p.idx, p.e as t, coalesce(lead(mode) over (partition by p.video_id order by idx) <> mode, true) as edge from parts p union all
       select video_id, -1, s, true from parts where rn = 1""",
    "near": f"select q.*, coalesce({_NEAR.format(c='edge_ms', t='edges', tol=1500)}, t) as by_edge, case when edge then {_NEAR.format(c='cut_ms', t='cuts', tol=2000)} end as cut from q",
    "snapped": """select video_id, idx, t, case when cut is not null and not exists (select 1 from sentences s where s.video_id = n.video_id and s.start_ms + 150 < cut and cut < s.end_ms - 150) then cut else by_edge end as t1 from near n""",
    "placed": """select s.video_id, s.idx, coalesce(arg_min(case when t1 - w.start_ms <= w.end_ms - t1 then w.start_ms else w.end_ms end, w.start_ms), any_value(t1)) as move
       from snapped s left join words w on w.video_id = s.video_id and w.start_ms + 10 < t1 and t1 < w.end_ms - 10 group by s.video_id, s.idx""",
    "open_": """select p.video_id, case when abs(f.move - p.s) >= 10 and p.e - f.move >= 1500 then f.move else p.s end as opening from parts p join placed f on f.video_id = p.video_id and f.idx = -1 where rn = 1""",
    "fin": """select p.*, m.move, o.opening, case when rn = n then case when abs(m.move - p.e) >= 10 and m.move - (case when rn = 1 then o.opening else p.s end) >= 1500 then m.move else p.e end end as closing
       from parts p join placed m on m.video_id = p.video_id and m.idx = p.idx join open_ o on o.video_id = p.video_id""",
    "nx": "select *, lead(coalesce(closing, e)) over (partition by video_id order by idx) as next_end from fin",
    "walk": """select video_id, rn, case when rn = n then closing when abs(move - e) >= 10 and move - opening >= 1500 and next_end - move >= 1500 then move else e end as fin from nx where rn = 1 union all
       select x.video_id, x.rn, case when x.rn = x.n then x.closing when abs(x.move - x.e) >= 10 and x.move - w.fin >= 1500 and x.next_end - x.move >= 1500 then x.move else x.e end
       from walk w join nx x on x.video_id = w.video_id and x.rn = w.rn + 1""",
    "done": "select x.video_id, x.idx, x.mode, x.opening, w.fin from walk w join nx x using (video_id, rn)"}).replace("walk as materialized", "walk as"))
def snap_parts(spark, folder):
    s, w = sentences(spark, folder), words(spark, folder)
    parts = s.select("video_id", "idx", "start_ms", "end_ms", F.when(F.col("role") == "assistant", "narrate").otherwise("orig").alias("mode"))
    edges = w.filter("pos % 9 = 4").select("video_id", (F.col("start_ms") + 120).alias("edge_ms"))
    cuts = w.filter("pos % 13 = 6").select("video_id", (F.col("end_ms") + 60).alias("cut_ms"))
    return cp.snap_parts(parts, edges, cuts, s, w, KEY, CHUNK, BUCKET)
