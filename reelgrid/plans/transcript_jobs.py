"""Transcript corpus jobs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelgrid.functions import fixed_values as fv, text as tx
from reelgrid.operators import transcripts as tr
from reelgrid.plans.registry import query
from reelgrid.plans.sqltext import N_TOKENS, NORM, SPACELESS, TOKEN, is_cta_sql, is_greeting_sql, is_junk_sql, is_promo_sql
from reelgrid.sources.standins import doc_lines, sentences, with_tables, words
from reelgrid.sources.tables import read_table, read_texts

KEY = ["video_id"]


def _docs(spark, folder):
    return read_texts(spark, folder, "documents")


@query(f"select doc_id, {NORM('text')} as norm from documents")
def normalised_corpus(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.norm_text(F.col("text")).alias("norm"))


@query(f"select doc_id, {N_TOKENS('n')} as n_tokens, len(list_distinct(regexp_extract_all(n, '{TOKEN}'))) as n_distinct from (select doc_id, {NORM('text')} as n from documents)")
def token_counts(spark, folder):
    t = tx.tokens(F.col("n"))
    return (_docs(spark, folder).select("doc_id", tx.norm_text(F.col("text")).alias("n"))
            .select("doc_id", tx.n_tokens(F.col("n")).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct")))


_LINES = {"ln": f"select *, {N_TOKENS('norm')} as n_words from (select *, {NORM('text')} as norm from doc_lines)",
          "mk": f"select *, {is_cta_sql('norm')} as cta, {is_greeting_sql('norm')} as greeting, {is_promo_sql('norm')} as promo from ln"}


@query(with_tables("""select channel, count(*) as lines, count_if(cta) as cta, count_if(greeting) as greeting, count_if(promo) as promo,
    cast(sum(case when cta or greeting or promo then n_words else 0 end) as bigint) as junk_words, cast(sum(n_words) as bigint) as words from mk group by 1""", "doc_lines", more=_LINES))
def junk_report(spark, folder):
    d = (doc_lines(spark, folder).select("channel", tx.norm_text(F.col("text")).alias("norm"))
         .select("channel", tx.n_tokens(F.col("norm")).alias("n"), tx.is_cta(F.col("norm")).alias("cta"),
                 tx.is_greeting(F.col("norm")).alias("greeting"), tx.is_promo(F.col("norm")).alias("promo")))
    junk = F.col("cta") | F.col("greeting") | F.col("promo")
    return d.groupBy("channel").agg(F.count("*").alias("lines"), F.count_if("cta").alias("cta"), F.count_if("greeting").alias("greeting"),
                                    F.count_if("promo").alias("promo"), F.sum(F.when(junk, F.col("n")).otherwise(0)).alias("junk_words"), F.sum("n").alias("words"))


_WINDOWS = _LINES | {
    "win": "select video_id, idx as win, start_ms as ws, start_ms + 20000 as we from doc_lines",
    "pairs": """select w.video_id, w.win, w.ws, w.we, m.idx, m.n_words, m.cta or m.greeting or m.promo as junk,
       (least(w.we, m.end_ms) - greatest(w.ws, m.start_ms)) / greatest(1, m.end_ms - m.start_ms) as share
       from win w join mk m on m.video_id = w.video_id and m.end_ms > w.ws and m.start_ms < w.we"""}


@query(with_tables("""select w.video_id, w.win, round(coalesce(sum(case when junk then n_words else 0 end) / nullif(sum(n_words), 0), 0), 6) as junk_ratio,
    round(coalesce(sum(n_words * share), 0) * 1000 / 20000, 6) as density from win w left join pairs p using (video_id, win) group by all""", "doc_lines", more=_WINDOWS))
def window_speech(spark, folder):
    d = doc_lines(spark, folder)
    win = d.select("video_id", F.col("idx").alias("win"), F.col("start_ms").alias("ws"), (F.col("start_ms") + 20_000).alias("we"))
    out = tr.window_speech(win, tr.scored_sentences(d, KEY), KEY, ["win"], "ws", "we", 60_000)
    return out.select("video_id", "win", F.round("junk_ratio", 6).alias("junk_ratio"), F.round("density", 6).alias("density"))


_REST = "clean"
for _p in fv.INVENTED_PHRASES:
    _REST = f"replace({_REST}, '{_p}', ' ')"
_PRES = {"pr": """select doc_id, n_words, dur, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as clean from (
      select doc_id, text, len(regexp_extract_all(text, '\\S+')) as n_words, case when doc_id % 50 = 0 then 0 else n_chars * (60 + doc_id % 900) end as dur from documents)""",
         "pw": f"""select doc_id, case when dur <= 0 then '' when clean = '' then 'empty' when n_words * 1000 / dur < 0.5 then 'sparse'
      when {N_TOKENS(_REST)} <= greatest(2, {N_TOKENS('clean')} // 10) then 'invented' else '' end as why from pr"""}


@query(with_tables("select doc_id, why = '' as speech, why from pw", more=_PRES))
def speech_presence(spark, folder):
    d = _docs(spark, folder).select("doc_id", "text", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n_words"),
                                    F.when(F.col("doc_id") % 50 == 0, 0).otherwise(F.col("n_chars") * (60 + F.col("doc_id") % 900)).alias("dur"))
    return tr.speech_presence(d, "doc_id", "text", "n_words", "dur")


_EN = "[" + ",".join("'" + w.replace("'", "''") + "'" for w in fv.ENGLISH_FUNCTION_WORDS) + "]"
_CYR = "len(regexp_extract_all(text, '\\p{Cyrillic}'))"


@query(f"""select source, stored, resolved, count(*) as n from (select source, stored, case when nonlatin * 100 >= letters * 15 and letters > 0 then 'other'
      when stored <> '' and stored <> 'en' and len(w) >= 25 and len(list_filter(w, lambda x: list_contains({_EN}, x))) * 100 >= len(w) * 22 then 'en' else stored end as resolved from (
      select source, case when doc_id % 3 = 0 then 'mi' else lang end as stored, len(regexp_extract_all(text, '\\p{{L}}')) as letters,
      len(regexp_extract_all(text, '[぀-ヿㇰ-ㇿｦ-ﾟ가-힣฀-๿Ѐ-ӿ؀-ۿऀ-ॿ֐-׿㐀-䶿一-鿿豈-﫿]')) as nonlatin, regexp_extract_all(lower(text), '[a-z'']+') as w from documents)) group by all""")
def language_audit(spark, folder):
    d = _docs(spark, folder).withColumn("stored", F.when(F.col("doc_id") % 3 == 0, "mi").otherwise(F.col("lang")))
    return tr.language_audit(d, "source", "stored", "text")


_VI = "[" + fv.VIETNAMESE_LETTERS + "]"


@query(f"""select doc_id, len(regexp_extract_all(t, '{_VI}')) >= 2 and len(regexp_extract_all(t, '{_VI}')) * 10 > len(regexp_extract_all(t, '\\p{{L}}')) as vietnamese
    from (select doc_id, lower(nfc_normalize(text)) as t from documents)""")
def vietnamese_marks(spark, folder):
    return _docs(spark, folder).select("doc_id", tx.looks_vietnamese(F.col("text")).alias("vietnamese"))


_STOPCAP = ",".join("'" + w + "'" for w in fv.CAPTION_STOP)


@query(with_tables(f"""select video_id, word, n from (
    select video_id, lower(regexp_replace(trim(word), '^[.,!?;:"''…-]+|[.,!?;:"''…-]+$', '', 'g')) as word, count(*) as n from words group by all) where length(word) >= 2 and word not in ({_STOPCAP})""", "words"))
def keyword_frequency(spark, folder):
    bare = F.lower(F.regexp_replace(F.trim("word"), r"^[.,!?;:\"'…-]+|[.,!?;:\"'…-]+$", ""))
    return (words(spark, folder).filter(tx.is_keyword(F.col("word"))).groupBy("video_id", bare.alias("word")).agg(F.count("*").alias("n")))


@query(f"""select item_id, doc_id from (select item_id, {NORM('text')} as q from benchmark) b join (select doc_id, {NORM('text')} as body from documents) d
    on contains(body, q) where length(q) >= 15 and {N_TOKENS('q')} >= 4""")
def copied_narration(spark, folder):
    return tr.copied_lines(read_table(spark, folder, "benchmark"), _docs(spark, folder), "item_id", "doc_id")


_PRON = "[" + ",".join(f"'{w}'" for w in fv.PRONOUNS) + "]"
_STOP = "[" + ",".join(f"'{w}'" for w in dict.fromkeys(fv.STOP_VI + fv.STOP_EN + fv.STOP_HI)) + "]"
_HI = "[" + ",".join(f"'{w}'" for w in fv.STOP_HI) + "]"


def _seq(c: str) -> str:
    stem = " ".join(f"when regexp_matches(x, '^.{{3,}}{e}$') then substr(x, 1, length(x) - {len(e)})" for e in ("ing", "ed", "es", "s"))
    return (f"list_filter(list_transform(list_filter(string_split({c}, ' '), lambda x: x <> ''), lambda x: case when list_contains({_PRON}, x) then '§p' {stem} else x end), "
            f"lambda x: x = '§p' or (length(x) > 1 and not list_contains({_STOP}, x)))")


def _grams(c: str) -> str:
    return f"list_transform(generate_series(1, len({c}) - 2), lambda i: {c}[i] || ' ' || {c}[i + 1] || ' ' || {c}[i + 2])"


_RETELL = {
    "nar": f"""select s.video_id, s.idx as part, s.start_ms, s.end_ms, {NORM("o.text")} as norm from sentences s
       join sentences o on o.video_id = case when s.idx % 2 = 0 then s.video_id else s.video_id + 1 end and o.idx = s.idx
       where not regexp_matches(o.text, '[{SPACELESS}]')""",
    "sp": f"select video_id, idx, start_ms, end_ms, {NORM('text')} as norm from sentences",
    "said": """select n.video_id, n.part, n.norm as own, k.pad, string_agg(p.norm, ' ' order by p.start_ms, p.idx) as said from nar n, (values (0), (6000)) k(pad), sp p
       where p.video_id = n.video_id and p.end_ms > n.start_ms - k.pad and p.start_ms < n.end_ms + k.pad and p.norm <> '' group by all""",
    "sq": f"""select *, {_seq('own')} as a, {_seq('said')} as b, list_filter(string_split(own, ' '), lambda x: x <> '' and not list_contains({_HI}, x)) as w, string_split(said, ' ') as sw from said""",
    "gr": f"select *, {_grams('a')} as ga, {_grams('b')} as gb from sq"}


@query(with_tables("""select video_id, part, bool_or((len(w) >= 4 and len(list_filter(w, lambda x: list_contains(sw, x))) * 100 > len(w) * 45)
    or (len(list_distinct(a)) >= 4 and len(list_intersect(list_distinct(a), list_distinct(b))) * 100 >= len(list_distinct(a)) * 55)
    or list_has_any(ga, gb)) as retold from gr group by all""", "sentences", more=_RETELL))
def retold_narration(spark, folder):
    s = sentences(spark, folder).select("video_id", "idx", "start_ms", "end_ms", "text")
    other = s.select(F.col("video_id").alias("src"), "idx", F.col("text").alias("said"))
    src = F.when(F.col("idx") % 2 == 0, F.col("video_id")).otherwise(F.col("video_id") + 1)
    nar = (s.drop("text").withColumn("src", src).join(other, ["src", "idx"])
           .select("video_id", F.col("idx").alias("part"), "start_ms", "end_ms", F.col("said").alias("text")))
    return tr.verbatim_and_retold(nar, s, KEY, 60_000)


_CW = f"list_distinct(list_filter(string_split(norm, ' '), lambda x: length(x) > 1 and not list_contains({_STOP}, x)))"
_REL = {"cw": f"select video_id, idx, {_CW} as cw from (select video_id, idx, {NORM('text')} as norm from sentences)",
        "nb": "select a.video_id, a.idx, list_distinct(flatten(list(b.cw))) as near from cw a join cw b on b.video_id = a.video_id and b.idx in (a.idx - 1, a.idx + 1) group by all"}


@query(with_tables("""select c.video_id, c.idx, len(c.cw) > 0 and (list_has_any(c.cw, near) or list_has_any(list_transform(list_filter(c.cw, lambda x: length(x) >= 4), lambda x: substr(x, 1, 4)),
    list_transform(list_filter(near, lambda x: length(x) >= 4), lambda x: substr(x, 1, 4)))) as relevant from cw c join nb n using (video_id, idx)""", "sentences", more=_REL))
def relevance_to_neighbours(spark, folder):
    cw = sentences(spark, folder).select("video_id", "idx", tx.content_words(tx.norm_text(F.col("text"))).alias("cw"))
    near = (cw.select("video_id", F.explode(F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("idx"), "cw")
            .groupBy("video_id", "idx").agg(F.array_distinct(F.flatten(F.collect_list("cw"))).alias("near")))      # two neighbours
    def starts(c):
        return F.transform(F.filter(c, lambda x: F.length(x) >= 4), lambda x: F.substring(x, 1, 4))
    ok = F.arrays_overlap("cw", "near") | F.arrays_overlap(starts(F.col("cw")), starts(F.col("near")))
    return cw.join(near, ["video_id", "idx"]).select("video_id", "idx", (ok & (F.size("cw") > 0)).alias("relevant"))


_GAPPED = {"gs": "select video_id, idx, start_ms + idx * 2500 as start_ms, end_ms + idx * 2500 - (idx % 3) * 400 as end_ms, text from sentences",
           "gaps": """select video_id, gap_s, gap_e, rank from (select *, row_number() over (partition by video_id order by gap_e - gap_s desc, gap_s) as rank from (
             select video_id, end_ms as gap_s, lead(start_ms) over (partition by video_id order by start_ms, idx) as gap_e from gs) where gap_e - gap_s >= 2600) where rank <= 8"""}


def _gapped(spark, folder):
    return sentences(spark, folder).select(
        "video_id", "idx", (F.col("start_ms") + F.col("idx") * 2500).alias("start_ms"),
        (F.col("end_ms") + F.col("idx") * 2500 - (F.col("idx") % 3) * 400).alias("end_ms"), "text")


@query(with_tables("select * from gaps", "sentences", more=_GAPPED))
def transcript_gaps(spark, folder):
    return tr.transcript_gaps(_gapped(spark, folder), KEY, 600_000, 2600)


@query(with_tables("""select video_id, start_ms, end_ms, text from gs union all
    select r.video_id, greatest(r.start_ms, gap_s), least(r.end_ms, gap_e), r.text from (select video_id, end_ms - 700 as start_ms, end_ms + 1900 as end_ms, role as text from
      (select g.*, s.role from gs g join sentences s using (video_id, idx))) r join gaps g on r.video_id = g.video_id
    and r.end_ms > gap_s and r.start_ms < gap_e and r.start_ms < gap_e - 50 and r.end_ms > gap_s + 50""", "sentences", more=_GAPPED))
def merge_gap_fill(spark, folder):
    g = _gapped(spark, folder)
    role = sentences(spark, folder).select("video_id", "idx", "role")
    rec = g.drop("text").join(role, ["video_id", "idx"]).select("video_id", (F.col("end_ms") - 700).alias("start_ms"), (F.col("end_ms") + 1900).alias("end_ms"), F.col("role").alias("text"))
    return tr.fill_gaps(g, rec, tr.transcript_gaps(g, KEY, 600_000, 2600), KEY, 60_000)


@query(with_tables("""select s.video_id, s.idx, s.start_ms + s.idx * 600000 as start_ms, s.end_ms + s.idx * 600000 as end_ms, l.language from sentences s
    left join (select video_id, arg_min(role, case when idx > 0 then idx end) as language from sentences group by 1) l using (video_id)
    where s.video_id not in (select video_id from sentences where idx = 6)""", "sentences"))
def stitch_chunks(spark, folder):
    s = sentences(spark, folder)
    chunks = s.select("video_id", F.col("idx").alias("chunk_idx"), F.when(F.col("idx") > 0, F.col("role")).otherwise("").alias("language"), (F.col("idx") != 6).alias("ok"))
    rows = s.select("video_id", "idx", F.col("idx").alias("chunk_idx"), "start_ms", "end_ms")
    return tr.stitch_chunks(rows, chunks, "video_id", 600_000).select("video_id", "idx", "start_ms", "end_ms", "language")


@query("""select doc_id, trim(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(regexp_replace(t, '\\[[a-zA-Z][a-zA-Z ''\\-]{0,28}\\]', ' ', 'g'), '\\p{L}+|[^\\p{L}]+'),
    lambda x: case when length(x) >= 2 and x = upper(x) and x <> lower(x) then lower(x) else x end), ''), '\\s+([,.!?…;:])', '\\1', 'g'), '\\s{2,}', ' ', 'g')) as clean
    from (select doc_id, '[excited] WHAT a NIGHT-OUT, ' || text || ' [dramatic pause] THE END !' as t from documents)""")
def clean_narration(spark, folder):
    t = F.concat(F.lit("[excited] WHAT a NIGHT-OUT, "), "text", F.lit(" [dramatic pause] THE END !"))
    return _docs(spark, folder).select("doc_id", tx.clean_narration(t).alias("clean"))
