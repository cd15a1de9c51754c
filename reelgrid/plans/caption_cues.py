"""Caption cues: words and sentences on the edited timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.operators import cues as cu
from reelgrid.plans.registry import query
from reelgrid.plans.sqltext import TOKEN
from reelgrid.sources.standins import segments, sentences, with_tables, words

KEY, CHUNK, BUCKET = ["video_id"], 600_000, 60_000
CLIP = ["video_id", "clip_id"]

# two clips per conversation: one of the even turns, one of the odd ones in reverse order
_CL = {"cl": "select video_id, idx % 2 as clip_id, case when idx % 2 = 0 then idx else 100 - idx end as seg_idx, start_ms + 500 as s_ms, end_ms - 300 as e_ms from sentences where end_ms - start_ms > 1000",
       "pl": "select *, cast(coalesce(sum(e_ms - s_ms) over (partition by video_id, clip_id order by seg_idx rows between unbounded preceding and 1 preceding), 0) as bigint) as off from cl",
       "rw": """select video_id, clip_id, seg_idx, word_id, trim(word) as word, off + start_ms - s_ms as a, greatest(off + start_ms - s_ms + 60, off + least(end_ms, e_ms) - s_ms) as b
          from words join pl using (video_id) where s_ms <= start_ms and start_ms < e_ms"""}


def clip_segments(spark, folder):
    s = sentences(spark, folder).filter("end_ms - start_ms > 1000")
    return s.select("video_id", (F.col("idx") % 2).alias("clip_id"), F.when(F.col("idx") % 2 == 0, F.col("idx")).otherwise(100 - F.col("idx")).alias("seg_idx"),
                    (F.col("start_ms") + 500).alias("s_ms"), (F.col("end_ms") - 300).alias("e_ms"))


def _words(spark, folder):
    return cu.remap_words(words(spark, folder), clip_segments(spark, folder), KEY, CLIP, BUCKET)


@query(with_tables("select * from rw", "sentences", "words", more=_CL))
def remap_words(spark, folder):
    return _words(spark, folder)


@query(with_tables("""select video_id, clip_id, idx, arg_min(off + least(greatest(t, s_ms), e_ms) - s_ms, seg_idx) as out_ms from (select video_id, idx, start_ms + 480 as t from sentences)
    join pl using (video_id) where s_ms - 50 <= t and t <= e_ms + 50 group by all""", "sentences", more=_CL))
def timeline_remap(spark, folder):
    pts = sentences(spark, folder).select("video_id", "idx", (F.col("start_ms") + 480).alias("t"))
    return cu.remap_points(pts, clip_segments(spark, folder), KEY, CLIP, ["idx"], "t", BUCKET)


@query(with_tables("""select video_id, clip_id, seg_idx, min(a) as start_ms, max(b) as end_ms, string_agg(text, ' ' order by a, idx) as text from (
    select *, sum(brk) over (partition by video_id, clip_id, seg_idx order by a, idx rows unbounded preceding) as isl from (
    select *, case when a - coalesce(max(b) over (partition by video_id, clip_id, seg_idx order by a, idx rows between unbounded preceding and 1 preceding), -1000000) < 400 then 0 else 1 end as brk from (
    select pl.video_id, clip_id, seg_idx, l.idx, trim(l.text) as text, off + greatest(start_ms, s_ms) - s_ms as a, off + least(end_ms, e_ms) - s_ms as b
    from pl join (select video_id, idx * 10 as idx, role as text, start_ms, start_ms + 900 as end_ms from sentences union all select video_id, idx * 10 + 1, 'x', start_ms + 1200, start_ms + 2000 from sentences
      union all select video_id, idx * 10 + 2, 'y', start_ms + 2500, start_ms + 3500 from sentences) l on l.video_id = pl.video_id and l.end_ms > s_ms and l.start_ms < e_ms) where b - a >= 250)) group by video_id, clip_id, seg_idx, isl""", "sentences", more=_CL))
def remap_sentences(spark, folder):
    s = sentences(spark, folder)
    def piece(n, text, low, high):
        return s.select("video_id", (F.col("idx") * 10 + n).alias("idx"), text.alias("text"), (F.col("start_ms") + low).alias("start_ms"), (F.col("start_ms") + high).alias("end_ms"))
    lines = (piece(0, F.col("role"), 0, 900).unionByName(piece(1, F.lit("x"), 1200, 2000)).unionByName(piece(2, F.lit("y"), 2500, 3500)))
    return cu.remap_sentences(lines, clip_segments(spark, folder), KEY, CLIP, BUCKET, CHUNK)


def _packed(limit: int, ms: int, gap: int) -> str:
    return with_tables("", "sentences", "words", more=_CL | {
        "r": "select *, row_number() over (partition by video_id, clip_id order by a, word_id) as rn from rw"}) + f""", walk as (
      select video_id, clip_id, rn, seg_idx, word, a, b, a as p0, 1 as n, 1 as phrase from r where rn = 1 union all
      select r.video_id, r.clip_id, r.rn, r.seg_idx, r.word, r.a, r.b,
        case when w.n >= {limit} or r.b - w.p0 > {ms} or r.a - w.b > {gap} or r.seg_idx <> w.seg_idx then r.a else w.p0 end,
        case when w.n >= {limit} or r.b - w.p0 > {ms} or r.a - w.b > {gap} or r.seg_idx <> w.seg_idx then 1 else w.n + 1 end,
        case when w.n >= {limit} or r.b - w.p0 > {ms} or r.a - w.b > {gap} or r.seg_idx <> w.seg_idx then w.phrase + 1 else w.phrase end
      from walk w join r on r.video_id = w.video_id and r.clip_id = w.clip_id and r.rn = w.rn + 1)
    select video_id, clip_id, min(a) as start_ms, arg_max(b, rn) as end_ms, count(*) as n, string_agg(word, ' ' order by rn) as text from walk group by video_id, clip_id, phrase"""


@query(_packed(3, 2400, 600))
def group_cues(spark, folder):
    return cu.group_cues(_words(spark, folder), CLIP, 3, 2400, 600, CHUNK).drop("run", "phrase")


@query(_packed(5, 2800, 600))
def sentence_cues(spark, folder):
    return cu.group_cues(_words(spark, folder), CLIP, 5, 2800, 600, CHUNK).drop("run", "phrase")


@query(with_tables("""select video_id, clip_id, word_id, word, a as start_ms, greatest(a + 50, case when ns = seg_idx and na - b < 450 then na else b + 150 end) as end_ms from (
    select *, lead(a) over w as na, lead(seg_idx) over w as ns from rw window w as (partition by video_id, clip_id order by a, word_id))""", "sentences", "words", more=_CL))
def word_hold_cues(spark, folder):
    return cu.word_hold_cues(_words(spark, folder), CLIP, CHUNK)


@query(with_tables(f"""select video_id, idx, pos - 1 as pos, word, start_ms + (pos - 1) * step as a, start_ms + pos * step as b from (select video_id, idx, start_ms, greatest(50, (end_ms - start_ms) // len(w)) as step,
    unnest(w) as word, generate_subscripts(w, 1) as pos from (select *, regexp_extract_all(text, '{TOKEN}') as w from sentences))""", "sentences"))
def even_words(spark, folder):
    return cu.even_words(sentences(spark, folder), KEY)


@query(with_tables("""select video_id, idx, pos - 1 as pos, text, start_ms + (end_ms - start_ms) * coalesce(before, 0) // total as a, start_ms + (end_ms - start_ms) * (coalesce(before, 0) + length(text)) // total as b from (
    select *, sum(length(text)) over (partition by video_id, idx order by pos rows between unbounded preceding and 1 preceding) as before, sum(length(text)) over (partition by video_id, idx) as total from (
    select video_id, idx, start_ms, end_ms, unnest(p) as text, generate_subscripts(p, 1) as pos from (select *, list_filter(string_split(regexp_replace(trim(text), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as p from sentences)))""", "sentences"))
def proportional_cues(spark, folder):
    return cu.proportional_cues(sentences(spark, folder), ["video_id", "idx"])


@query(with_tables("""select video_id, idx, cast(g as integer) as grp, array_to_string(w[g * 3 + 1 : g * 3 + 3], ' ') as text, start_ms + (end_ms - start_ms) * g * 3 // len(w) as a,
    start_ms + (end_ms - start_ms) * least((g + 1) * 3, len(w)) // len(w) as b from (select *, unnest(generate_series(0, (len(w) - 1) // 3)) as g from (
    select video_id, idx, start_ms, end_ms, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as w from sentences))""", "sentences"))
def phrase_groups(spark, folder):
    return cu.phrase_groups(sentences(spark, folder), ["video_id", "idx"])


_ALIGN = {"sc": "select video_id, idx, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') as w from sentences",
          "he": """select video_id, idx, row_number() over (partition by video_id, idx order by part) - 1 as pos, a, b from (
              select video_id, word_id // 100000 as idx, word_id - case when word_id % 5 = 4 then 1 else 0 end as part, min(start_ms + (word_id * 37 % 5) * 100) as a, max(end_ms) as b from words group by 1, 2, 3)""",
          "kk": "select video_id, idx, count(*) as k from he group by all",
          "tk": "select video_id, idx, k, len(w) as m, unnest(w) as token, generate_subscripts(w, 1) - 1 as i from sc join kk using (video_id, idx) where abs(len(w) - k) * 100 <= greatest(len(w), k) * 40",
          "tm": "select t.video_id, t.idx, t.i, t.token, x.a as a0, y.b as b0 from (select *, least(k - 1, i * k // m) as lo, least(k - 1, greatest(least(k - 1, i * k // m), (i + 1) * k // m - 1)) as hi from tk) t join he x on x.video_id = t.video_id and x.idx = t.idx and x.pos = t.lo join he y on y.video_id = t.video_id and y.idx = t.idx and y.pos = t.hi"}


@query(with_tables("select video_id, idx, i, token, a, greatest(a, b0) as b from (select *, max(a0) over (partition by video_id, idx order by i) as a from tm)", "sentences", "words", more=_ALIGN))
def align_tokens(spark, folder):
    # every fifth word is heard as one with the word before it, so that counts differ: four are heard where five are written
    part = F.col("pos") - F.when(F.col("pos") % 5 == 4, 1).otherwise(0)
    heard = (words(spark, folder).select("video_id", F.col("turn").alias("idx"), (part - F.floor(part / 5)).alias("pos"),
                                         (F.col("start_ms") + (F.col("pos") * 37 % 5) * 100).alias("a"), F.col("end_ms").alias("b"))
             .repartition("video_id", "idx").groupBy("video_id", "idx", "pos").agg(F.min("a").alias("a"), F.max("b").alias("b")))
    return cu.align_tokens(sentences(spark, folder), heard, ["video_id", "idx"])


_SPEECH = {"cue": "select s_ms - 700 as a, s_ms + 2500 as b, clip_id, video_id from segments where status = 'suggested'",
           "spe": "select video_id, s_ms as ss, s_ms + 1500 as se from segments where status = 'exported'"}


@query(with_tables("""select video_id, clip_id, greatest(a, f - 30) as a, least(b, l + 120) as b from (select c.video_id, clip_id, a, b, min(ss) as f, max(se) as l from cue c join spe s
    on s.video_id = c.video_id and c.b > ss and c.a < se group by all) where least(b, l + 120) - greatest(a, f - 30) >= 50""", "segments", more=_SPEECH))
def clamp_cues(spark, folder):
    t = segments(spark, folder)
    cue = t.filter("status = 'suggested'").select("video_id", "clip_id", (F.col("s_ms") - 700).alias("a"), (F.col("s_ms") + 2500).alias("b"))
    speech = t.filter("status = 'exported'").select("video_id", F.col("s_ms").alias("start_ms"), (F.col("s_ms") + 1500).alias("end_ms"))
    return cu.clamp_cues(cue, speech, KEY, ["clip_id"], BUCKET)


@query(with_tables("""select video_id, word_id, start_ms + bias as a, end_ms + bias as b from words join (select w.video_id, case when abs(s - c) > 120 then s - c else 0 end as bias from
    (select video_id, min(start_ms) as c from words group by 1) w join (select video_id, min(start_ms) + video_id % 300 as s from sentences group by 1) using (video_id)) using (video_id)""", "words"))
def shift_cues(spark, folder):
    w = words(spark, folder).select("video_id", "word_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    speech = sentences(spark, folder).select("video_id", (F.col("start_ms") + F.col("video_id") % 300).alias("start_ms"))
    return cu.shift_cues(w, speech, KEY).select("video_id", "word_id", "a", "b")


@query(with_tables("""select video_id, idx, pos - 1 as pos, word, start_ms + coalesce(before, 0) * 60 as a, start_ms + (coalesce(before, 0) + length(word)) * 60 as b from (
    select *, sum(length(word)) over (partition by video_id, idx order by pos rows between unbounded preceding and 1 preceding) as before from (
    select video_id, idx, start_ms, unnest(p) as word, generate_subscripts(p, 1) as pos from (select *, regexp_extract_all(text, '[^\\s.,!?;:…"'')\\]}»”’、。！？；：]*[.,!?;:…"'')\\]}»”’、。！？；：]|[^\\s.,!?;:…"'')\\]}»”’、。！？；：]+|\\s+') as p from sentences)))
    where trim(regexp_replace(word, '\\s', '', 'g')) <> ''""", "sentences"))
def chars_to_words(spark, folder):
    return cu.chars_to_words(sentences(spark, folder), ["video_id", "idx"], 60)


@query(with_tables("""select video_id, t from (select *, row_number() over (partition by video_id order by t) - 1 as i, count(*) over (partition by video_id) as n from (select distinct video_id, s_ms as t from segments where status = 'exported'))
    where n <= 12 or list_contains(list_transform(generate_series(0, 11), lambda k: cast(round_even(k * (n - 1) / 11.0, 0) as bigint)), i)""", "segments"))
def thin_evenly(spark, folder):
    t = segments(spark, folder).filter("status = 'exported'").select("video_id", F.col("s_ms").alias("t")).distinct()
    return cu.thin_evenly(t, KEY, "t", CHUNK)
