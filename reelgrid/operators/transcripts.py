"""Transcript jobs: junk and density of windows, speech presence, language audit, retellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgrid.functions import fixed_values as fv, text as tx
from reelgrid.operators.joins import overlap_join
from reelgrid.operators.scan import next_value, scan, time_chunk
from reelgrid.session import checkpointed


def scored_sentences(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences with word counts and junk marks, without their text."""
    return (sentences.withColumn("norm", tx.norm_text(F.col("text")))
            .select(*keys, "idx", "start_ms", "end_ms", tx.n_tokens(F.col("norm")).alias("n_words"),
                    tx.is_junk(F.col("norm")).alias("junk"), tx.is_cta(F.col("norm")).alias("cta")))


def window_speech(windows: DataFrame, sentences: DataFrame, keys: list[str], win: list[str],
                  s: str, e: str, bucket: int) -> DataFrame:
    """Junk share (whole sentences) and words per second (by overlap) of each window.

    A window may consist of several ranges; a sentence touching two of them counts once for junk.
    """
    ranges = windows.select(*keys, *win, s, e)
    pairs = overlap_join(ranges, sentences, keys, (s, e), ("start_ms", "end_ms"), bucket)
    share = ((F.least(e, "end_ms") - F.greatest(s, "start_ms"))
             / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")))
    once = (pairs.groupBy(*keys, *win, "idx")
            .agg(F.max("n_words").alias("n"), F.bool_or("junk").alias("junk"), F.sum(F.col("n_words") * share).alias("part"))
            .groupBy(*keys, *win).agg(F.sum("n").alias("words"), F.sum("part").alias("spoken"),
                                      F.sum(F.when(F.col("junk"), F.col("n")).otherwise(0)).alias("junk_words")))
    span = ranges.groupBy(*keys, *win).agg(F.sum(F.col(e) - F.col(s)).alias("span_ms"))
    return (span.join(once, [*keys, *win], "left").na.fill(0)
            .withColumn("junk_ratio", F.when(F.col("words") > 0, F.col("junk_words") / F.col("words")).otherwise(0.0))
            .withColumn("density", F.col("spoken") * 1000 / F.greatest(F.lit(1), F.col("span_ms"))))


def speech_presence(docs: DataFrame, key: str, text: str, n_words: str, duration_ms: str) -> DataFrame:
    """Whether a transcript holds real speech: dense enough and not only phrases recognisers invent."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))
    rows = docs.withColumn("__clean", clean)
    rest = F.col("__clean")
    for phrase in fv.INVENTED_PHRASES:
        rest = F.replace(rest, F.lit(phrase), F.lit(" "))
    rows = rows.withColumn("__n", tx.n_tokens(F.col("__clean"))).withColumn("__rest", tx.n_tokens(rest))
    per_s = F.col(n_words) * 1000 / F.col(duration_ms)
    why = (F.when(F.col(duration_ms) <= 0, "").when(F.col("__clean") == "", "empty").when(per_s < 0.5, "sparse")
           .when(F.col("__rest") <= F.greatest(F.lit(2), F.floor(F.col("__n") / 10)), "invented").otherwise(""))
    return rows.select(key, (why == "").alias("speech"), why.alias("why"))


def language_audit(docs: DataFrame, source: str, label: str, text: str) -> DataFrame:
    """Stored label against the label resolved from the text, counted per source."""
    marks = docs.select(source, label, *tx.script_counts(F.col(text)), *tx.english_counts(F.col(text)))
    resolved = tx.resolved_label(F.col(label), tx.script_from_counts(), tx.english_from_counts())
    return (marks.withColumn("resolved", resolved).groupBy(source, label, "resolved")
            .agg(F.count("*").alias("n")))


def verbatim_and_retold(narration: DataFrame, sentences: DataFrame, keys: list[str], bucket: int,
                        pad: int = 6000) -> DataFrame:
    """Mark narration lines that copy or retell what is said around them.

    `narration`: keys, part, start_ms, end_ms, text. A line is a retelling when in its own span or
    the span widened by `pad` more than 45 % of its words are spoken, or at least 55 % of its four or
    more content words, or three content words in a row. Text in spaceless scripts is not judged.
    """
    lines = (narration.withColumn("norm", tx.norm_text(F.col("text"))).filter(~tx.has_spaceless(F.col("text")))
             .select(*keys, "part", F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"), F.col("norm").alias("own_norm")))
    # the content words of a text are those of its sentences one after the other, so each sentence is read once
    spoken = (sentences.withColumn("norm", tx.norm_text(F.col("text"))).filter("norm <> ''")
              .select(*keys, "idx", "start_ms", "end_ms", "norm", F.array_join(tx.content_sequence(F.col("norm")), " ").alias("seq")))
    wide = lines.select(*keys, "part", "ps", "pe", (F.col("ps") - pad).alias("ws"), (F.col("pe") + pad).alias("we"))
    pairs = overlap_join(wide, spoken, keys, ("ws", "we"), ("start_ms", "end_ms"), bucket)
    near = (F.col("end_ms") > F.col("ps")) & (F.col("start_ms") < F.col("pe"))

    def told(items, field):
        return F.filter(F.split(F.array_join(F.transform(items, lambda x: x[field]), " "), " "), lambda w: w != "")
    # a line spans seconds, so the sentences around it are few
    around = (pairs.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("start_ms", "idx", "norm", "seq", near.alias("near")))).alias("w"))
              .select(*keys, "part", told(F.col("w"), "norm").alias("said_words"), told(F.col("w"), "seq").alias("said_seq"),
                      told(F.filter("w", lambda x: x["near"]), "seq").alias("near_seq")))
    own_words = F.filter(F.split("own_norm", " "), lambda w: (w != "") & ~w.isin(fv.STOP_HI))
    rows = lines.select(*keys, "part", own_words.alias("ws"), tx.content_sequence(F.col("own_norm")).alias("seq")).join(around, [*keys, "part"])
    rows = tx.settled(rows, "known", F.array_intersect("ws", "said_words"))
    hits = F.size(F.filter("ws", lambda w: F.array_contains(F.col("known"), w)))
    # what is said in the own span is said in the wide one too; only runs of three may differ
    fuzzy = (F.size("ws") >= 4) & (hits * 100 > F.size("ws") * 45)
    own = F.array_distinct("seq")
    retold = (F.size(own) >= 4) & (F.size(F.array_intersect(own, F.col("said_seq"))) * 100 >= F.size(own) * 55)
    run = [F.arrays_overlap(tx.grams(F.col("seq")), tx.grams(F.col(c))) for c in ("said_seq", "near_seq")]
    return rows.groupBy(*keys, "part").agg(F.bool_or(fuzzy | retold | run[0] | run[1]).alias("retold"))


def copied_lines(narration: DataFrame, corpus: DataFrame, line: str, doc: str) -> DataFrame:
    """Narration lines contained word for word in a transcript: at least 15 characters and 4 words.

    Candidates share the line's rarest three-word run, found through one equi-join of runs; only
    those pairs are compared as text.
    """
    lines = narration.select(line, tx.norm_text(F.col("text")).alias("norm")).filter(F.length("norm") >= 15)
    lines = tx.settled(lines, "toks", tx.tokens(F.col("norm"))).filter(F.size("toks") >= 4)
    texts = corpus.select(doc, tx.norm_text(F.col("text")).alias("body"))
    # the first and last token of a line may be cut inside a word of the text; the inner ones are
    # whole wherever the line occurs, so every true pair shares each inner run
    lines = tx.settled(lines, "inner", F.slice("toks", F.lit(2), F.size("toks") - 2))
    inner, body = F.col("inner"), F.col("body_toks")
    asked = lines.select(line, F.explode(
        F.when(F.size(inner) >= 3, tx.grams(inner, 3)).otherwise(tx.grams(inner, 2))).alias("g"))
    four = not lines.filter(F.size(inner) < 3).isEmpty()       # lines of four tokens have only a pair inside
    found = F.concat(tx.grams(body, 3), tx.grams(body, 2)) if four else tx.grams(body, 3)
    held = (tx.settled(texts, "body_toks", tx.tokens(F.col("body"))).select(doc, F.explode(found).alias("g"))
            .join(asked.select("g").distinct(), "g", "left_semi").distinct())
    held = checkpointed(held)          # small beside the corpus, and read twice
    freq = held.groupBy("g").agg(F.count("*").alias("df"))
    rare = (asked.join(freq, "g").groupBy(line).agg(F.min_by("g", F.struct("df", "g")).alias("g")))
    return (rare.join(held, "g").select(line, doc).join(lines.select(line, "norm"), line).join(texts, doc)
            .filter(F.expr("contains(body, norm)")).select(line, doc))


def transcript_gaps(sentences: DataFrame, keys: list[str], chunk: int, shortest: int = 2000, top: int = 8) -> DataFrame:
    """Longest pauses between consecutive sentences."""
    from reelgrid.operators.intervals import top_per_key
    seen = scan(sentences.select(*keys, "idx", "start_ms", "end_ms"), keys, ["start_ms", "idx"], time_chunk("start_ms", chunk),
                nxt=next_value(F.col("start_ms")))
    gaps = (seen.filter(F.col("nxt") - F.col("end_ms") >= shortest)
            .select(*keys, F.col("end_ms").alias("gap_s"), F.col("nxt").alias("gap_e")))
    return top_per_key(gaps, keys, [(F.col("gap_e") - F.col("gap_s")).desc(), F.col("gap_s")], top)


def fill_gaps(sentences: DataFrame, recovered: DataFrame, gaps: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Sentences plus recovered ones clipped to the gap they fall into, if they hold two letters."""
    pairs = overlap_join(recovered.select(*keys, "start_ms", "end_ms", "text"), gaps.select(*keys, "gap_s", "gap_e"),
                         keys, ("start_ms", "end_ms"), ("gap_s", "gap_e"), bucket)
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) >= 2
    inside = (F.col("start_ms") < F.col("gap_e") - 50) & (F.col("end_ms") > F.col("gap_s") + 50)
    new = pairs.filter(letters & inside).select(*keys, F.greatest("start_ms", "gap_s").alias("start_ms"),
                                                F.least("end_ms", "gap_e").alias("end_ms"), "text")
    return sentences.select(*keys, "start_ms", "end_ms", "text").unionByName(new)


def stitch_chunks(rows: DataFrame, chunks: DataFrame, key: str, chunk_ms: int) -> DataFrame:
    """Chunk-relative rows on the video clock with the first known language; a video with a failed
    chunk gives nothing."""
    failed = chunks.filter("not ok").select(key).distinct()
    lang = chunks.groupBy(key).agg(F.min_by("language", F.when(F.trim("language") != "", F.col("chunk_idx"))).alias("language"))
    return (rows.join(failed, key, "left_anti").join(lang, key, "left")
            .withColumn("start_ms", F.col("start_ms") + F.col("chunk_idx") * chunk_ms)
            .withColumn("end_ms", F.col("end_ms") + F.col("chunk_idx") * chunk_ms))
