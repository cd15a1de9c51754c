"""Remapping onto the edited timeline and caption cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W
from pyspark.sql import types as T

from reelgrid.functions import text as tx
from reelgrid.operators.folds import fold_runs
from reelgrid.operators.intervals import islands
from reelgrid.operators.joins import overlap_join, points_in_spans
from reelgrid.operators.scan import last_value, next_value, row_number, running_sum, scan, time_chunk


def with_offsets(segs: DataFrame, clip: list[str]) -> DataFrame:
    """Output time at which each segment of a clip begins, in clip order."""
    length = F.col("e_ms") - F.col("s_ms")
    return scan(segs, clip, ["seg_idx"], F.floor(F.col("seg_idx") / 512), offset=running_sum(length, False))


def remap_points(points: DataFrame, segs: DataFrame, keys: list[str], clip: list[str], point: list[str],
                 t: str, bucket: int, slack: int = 50) -> DataFrame:
    """Output time of each source time, by the first segment that holds it (with slack)."""
    placed = with_offsets(segs, clip)
    hit = points_in_spans(points, placed, keys, t, ("s_ms", "e_ms"), bucket, "both", slack)
    at = F.col("offset") + F.least(F.greatest(F.col(t), F.col("s_ms")), F.col("e_ms")) - F.col("s_ms")
    return (hit.withColumn("__at", at).groupBy(*clip, *point).agg(F.min_by("__at", "seg_idx").alias("out_ms")))


def remap_words(words: DataFrame, segs: DataFrame, keys: list[str], clip: list[str], bucket: int) -> DataFrame:
    """Words that start in a segment, on the output timeline, at least 60 ms long."""
    placed = with_offsets(segs, clip).withColumnsRenamed({"s_ms": "__s", "e_ms": "__e"})
    hit = points_in_spans(words.filter(F.trim("word") != ""), placed, keys, "start_ms", ("__s", "__e"), bucket)
    a = F.col("offset") + F.col("start_ms") - F.col("__s")
    b = F.col("offset") + F.least("end_ms", "__e") - F.col("__s")
    return hit.select(*clip, "seg_idx", "word_id", F.trim("word").alias("word"), a.alias("a"), F.greatest(a + 60, b).alias("b"))


def remap_sentences(sentences: DataFrame, segs: DataFrame, keys: list[str], clip: list[str], bucket: int,
                    chunk: int, join_gap: int = 400, shortest: int = 250) -> DataFrame:
    """Sentences clipped to segments, on the output timeline, joined when close in one segment."""
    placed = with_offsets(segs, clip).withColumnsRenamed({"s_ms": "__s", "e_ms": "__e"})
    pairs = overlap_join(placed, sentences.filter(F.trim("text") != ""), keys, ("__s", "__e"), ("start_ms", "end_ms"), bucket)
    a = F.col("offset") + F.greatest("start_ms", "__s") - F.col("__s")
    b = F.col("offset") + F.least("end_ms", "__e") - F.col("__s")
    rows = pairs.select(*clip, "seg_idx", "idx", F.trim("text").alias("text"), a.alias("a"), b.alias("b")).filter(F.col("b") - F.col("a") >= shortest)
    runs = islands(rows, [*clip, "seg_idx"], "a", "b", chunk, join_gap - 1).select(*clip, "seg_idx", "a", "island")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a", "idx", "text"))), lambda x: x["text"])
    return (rows.join(runs, [*clip, "seg_idx", "a"]).groupBy(*clip, "seg_idx", "island")
            .agg(F.max("b").alias("end_ms"), F.array_join(parts, " ").alias("text"))
            .withColumnRenamed("island", "start_ms"))


def group_cues(words: DataFrame, clip: list[str], most_words: int, most_ms: int, gap: int, chunk: int) -> DataFrame:
    """Words packed into phrases; a phrase ends at its word or time limit, a pause or a cut.

    Pauses and cuts split a clip into runs that do not depend on each other; only the packing
    inside a run is sequential.
    """
    prev = scan(words, clip, ["a", "word_id"], time_chunk("a", chunk), __pb=last_value(F.col("b"), False),
                __ps=last_value(F.col("seg_idx"), False))
    opens = F.col("__pb").isNull() | (F.col("a") - F.col("__pb") > gap) | (F.col("seg_idx") != F.col("__ps"))
    runs = scan(prev.withColumn("__o", opens.cast("long")), clip, ["a", "word_id"], time_chunk("a", chunk),
                run=running_sum(F.col("__o"))).drop("__pb", "__ps", "__o")

    def step(state: list, a: int, b: int) -> int:
        if not state:
            state[:] = [0, 1, a]
        elif state[1] >= most_words or b - state[2] > most_ms:
            state[:] = [state[0] + 1, 1, a]
        else:
            state[1] += 1
        return state[0]

    packed = fold_runs(runs, [*clip, "run"], ["a", "word_id"], ["a", "b"], list, step, "phrase", T.IntegerType())
    last = F.struct("a", "word_id")
    # a phrase holds at most `most_words` words
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a", "word_id", "word"))), lambda x: x["word"])
    return (packed.groupBy(*clip, "run", "phrase").agg(F.min("a").alias("start_ms"), F.max_by("b", last).alias("end_ms"),
                                                      F.count("*").alias("n"), F.array_join(parts, " ").alias("text")))


def word_hold_cues(words: DataFrame, clip: list[str], chunk: int, near: int = 450, tail: int = 150) -> DataFrame:
    """One cue per word, held until the next word of the segment if that follows soon."""
    nxt = scan(words, clip, ["a", "word_id"], time_chunk("a", chunk), __na=next_value(F.col("a")), __ns=next_value(F.col("seg_idx")))
    held = (F.col("__ns") == F.col("seg_idx")) & (F.col("__na") - F.col("b") < near)
    end = F.when(F.coalesce(held, F.lit(False)), F.col("__na")).otherwise(F.col("b") + tail)
    return nxt.select(*clip, "word_id", "word", F.col("a").alias("start_ms"), F.greatest(F.col("a") + 50, end).alias("end_ms"))


def even_words(sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a sentence spaced evenly, at least 50 ms apart."""
    w = tx.tokens(F.col("text"))
    rows = sentences.select(*keys, "idx", "start_ms", "end_ms", w.alias("w")).filter(F.size("w") > 0)
    step = F.greatest(F.lit(50), F.floor((F.col("end_ms") - F.col("start_ms")) / F.size("w")))
    return (rows.select(*keys, "idx", "start_ms", step.alias("step"), F.posexplode("w").alias("pos", "word"))
            .select(*keys, "idx", "pos", "word", (F.col("start_ms") + F.col("pos") * F.col("step")).alias("a"),
                    (F.col("start_ms") + (F.col("pos") + 1) * F.col("step")).alias("b")))


def _spread(items: Column, weight) -> Column:
    """Running weights before and after each item of an array, inside the row."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(items, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + weight(x).cast("long"))))


def proportional_cues(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences of a text spread over its span by their share of characters."""
    parts = F.filter(F.split(F.trim("text"), r"(?<=[.!?…])\s+"), lambda x: x != "")
    rows = texts.select(*keys, "start_ms", "end_ms", parts.alias("p"), _spread(parts, F.length).alias("c")).filter(F.size("p") > 0)
    span, total = F.col("end_ms") - F.col("start_ms"), F.element_at("c", -1)
    return (rows.select(*keys, "start_ms", "end_ms", "c", total.alias("total"), F.posexplode("p").alias("pos", "text"))
            .select(*keys, "pos", "text",
                    (F.col("start_ms") + F.floor(span * F.element_at("c", F.col("pos") + 1) / F.col("total"))).alias("a"),
                    (F.col("start_ms") + F.floor(span * F.element_at("c", F.col("pos") + 2) / F.col("total"))).alias("b")))


def phrase_groups(texts: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Groups of k words timed by their share of the words."""
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    rows = texts.select(*keys, "start_ms", "end_ms", w.alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    firsts = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / k).cast("int"))
    at = F.col("start_ms")
    span = F.col("end_ms") - F.col("start_ms")
    return (rows.select("*", F.explode(firsts).alias("grp"))
            .select(*keys, "grp", F.array_join(F.slice("w", F.col("grp") * k + 1, F.lit(k)), " ").alias("text"),
                    (at + F.floor(span * F.col("grp") * k / F.col("n"))).alias("a"),
                    (at + F.floor(span * F.least((F.col("grp") + 1) * k, F.col("n")) / F.col("n"))).alias("b")))


def align_tokens(script: DataFrame, heard: DataFrame, keys: list[str], worst: int = 40) -> DataFrame:
    """Clock of the heard words put on the script's words by position; starts never go back.

    A script whose length differs by more than `worst` percent from what was heard gives nothing. `heard`: keys, pos from 0 without gaps, a, b.
    What was heard is laid beside its script in one row, and only as far as a script of that length can use it.
    """
    words = script.select(*keys, F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("w")).withColumn("m", F.size("w").cast("long")).filter("m > 0")
    sizes = words.groupBy(*keys).agg(F.max("m").alias("most"))
    usable = F.col("pos") * (100 - min(worst, 100)) <= F.col("most") * 100
    clock = F.transform(F.array_sort(F.collect_list(F.when(usable, F.struct("pos", "a", "b")))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    clocks = heard.join(sizes, keys).groupBy(*keys).agg(F.count("*").alias("k"), clock.alias("clock"))
    rows = (words.join(clocks, keys).filter(F.abs(F.col("m") - F.col("k")) * 100 <= F.greatest("m", "k") * worst)
            .select(*keys, "m", "k", "clock", F.posexplode("w").alias("i", "token")))
    low = F.least(F.col("k") - 1, F.floor(F.col("i") * F.col("k") / F.col("m")))
    high = F.least(F.col("k") - 1, F.greatest(low, F.floor((F.col("i") + 1) * F.col("k") / F.col("m")) - 1))
    timed = rows.select(*keys, "i", "token", F.get("clock", low.cast("int"))["a"].alias("a0"), F.get("clock", high.cast("int"))["b"].alias("b0"))
    # the words of a script come from one row, which a task has held whole, so they need no chunks
    upto = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    return timed.withColumn("a", F.max("a0").over(upto)).select(*keys, "i", "token", "a", F.greatest("a", "b0").alias("b"))


def clamp_cues(cues: DataFrame, speech: DataFrame, keys: list[str], cue: list[str], bucket: int,
               before: int = 30, after: int = 120) -> DataFrame:
    """Cues cut to the speech they touch with small pads; cues outside speech are dropped."""
    sp = speech.select(*keys, F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"))
    pairs = overlap_join(cues, sp, keys, ("a", "b"), ("ss", "se"), bucket)
    touched = pairs.groupBy(*keys, *cue, "a", "b").agg(F.min("ss").alias("first"), F.max("se").alias("last"))
    return (touched.select(*keys, *cue, F.greatest(F.col("a"), F.col("first") - before).alias("a"),
                           F.least(F.col("b"), F.col("last") + after).alias("b")).filter(F.col("b") - F.col("a") >= 50))


def shift_cues(cues: DataFrame, speech: DataFrame, keys: list[str], least: int = 120) -> DataFrame:
    """Move all cues of a part when its first cue misses the first speech by more than `least`."""
    bias = (cues.groupBy(*keys).agg(F.min("a").alias("__c")).join(speech.groupBy(*keys).agg(F.min("start_ms").alias("__s")), keys)
            .select(*keys, F.when(F.abs(F.col("__s") - F.col("__c")) > least, F.col("__s") - F.col("__c")).otherwise(0).alias("bias")))
    moved = cues.join(bias, keys, "left").withColumn("bias", F.coalesce("bias", F.lit(0)))
    return moved.withColumn("a", F.col("a") + F.col("bias")).withColumn("b", F.col("b") + F.col("bias"))


# Punctuation that closes a word.
CLOSING = ".,!?;:…\"')\\]}»”’、。！？；："


def chars_to_words(texts: DataFrame, keys: list[str], ms_per_char: int) -> DataFrame:
    """Aligned characters grouped to words: white space separates, punctuation closes a word."""
    pieces = F.regexp_extract_all("text", F.lit(f"[^\\s{CLOSING}]*[{CLOSING}]|[^\\s{CLOSING}]+|\\s+"), F.lit(0))
    rows = texts.select(*keys, "start_ms", pieces.alias("p"), _spread(pieces, F.length).alias("c"))
    return (rows.select(*keys, "start_ms", "c", F.posexplode("p").alias("pos", "word")).filter(F.col("word").rlike(r"\S"))
            .select(*keys, "pos", "word", (F.col("start_ms") + F.element_at("c", F.col("pos") + 1) * ms_per_char).alias("a"),
                    (F.col("start_ms") + F.element_at("c", F.col("pos") + 2) * ms_per_char).alias("b")))


def thin_evenly(times: DataFrame, keys: list[str], t: str, chunk: int, cap: int = 12) -> DataFrame:
    """At most `cap` times per key, taken at even positions (half-even rounding)."""
    n = times.groupBy(*keys).agg(F.count("*").alias("__n"))
    pos = scan(times, keys, [t], time_chunk(t, chunk), __i=row_number()).join(n, keys)
    picks = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)),
                        lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(cap - 1)).cast("long"))
    keep = (F.col("__n") <= cap) | F.array_contains(picks, F.col("__i") - 1)
    return pos.filter(keep).drop("__n", "__i")


def deal_to_islands(texts: DataFrame, islands: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """Groups of k words dealt to speech islands: each island gets its share of the groups by length, rounded down, and the groups left go to
    the largest remainders (earlier islands on ties). Inside an island time follows the characters: keys, grp, text, a, b.

    `islands`: keys, isl, s_ms, e_ms; shares and remainders are whole numbers, so that every group finds an island.
    """
    w = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    rows = texts.select(*keys, w.alias("w")).withColumn("groups", F.ceil(F.size("w") / k).cast("long")).filter("groups > 0")
    length = F.greatest(F.lit(10), F.col("e_ms") - F.col("s_ms"))
    total = islands.groupBy(*keys).agg(F.sum(length).alias("total"))
    asked = (islands.join(total, keys).join(rows.select(*keys, "groups"), keys).withColumn("part", length * F.col("groups"))
             .withColumn("whole", F.floor(F.col("part") / F.col("total"))).withColumn("over", -(F.col("part") % F.col("total"))))
    spare = asked.groupBy(*keys).agg((F.max("groups") - F.sum("whole")).alias("spare"))
    ranked = scan(asked, keys, ["over", "isl"], F.floor(F.col("over") * 64 / F.col("total")), place=row_number()).join(spare, keys)
    counted = ranked.withColumn("n", F.col("whole") + (F.col("place") <= F.col("spare")).cast("long"))
    spans = (scan(counted.select(*keys, "isl", "s_ms", "e_ms", "n"), keys, ["isl"], F.floor(F.col("isl") / 512), upto=running_sum(F.col("n")))
             .filter("n > 0").withColumn("lo", F.col("upto") - F.col("n")))
    grp = rows.select(*keys, "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp")).select(
        *keys, "grp", F.array_join(F.slice("w", (F.col("grp") * k + 1).cast("int"), F.lit(k)), " ").alias("text"))
    held = points_in_spans(grp, spans.select(*keys, "isl", "s_ms", "e_ms", "lo", "upto"), keys, "grp", ("lo", "upto"), 512)
    chars = F.length("text").cast("long")
    # the groups of an island come from one text, which a task has held whole, so they need no chunks
    one = W.partitionBy(*keys, "isl")
    span = F.col("e_ms") - F.col("s_ms")
    timed = (held.select(*keys, "isl", "grp", "text", "s_ms", "e_ms").withColumn("all", F.sum(chars).over(one))
             .withColumn("seen", F.sum(chars).over(one.orderBy("grp").rowsBetween(W.unboundedPreceding, 0))))
    return timed.select(
        *keys, "grp", "text", (F.col("s_ms") + F.floor(span * (F.col("seen") - chars) / F.col("all"))).alias("a"),
        (F.col("s_ms") + F.floor(span * F.col("seen") / F.col("all"))).alias("b"))


def phrase_groups_heard(words: DataFrame, keys: list[str], order: list[str], position: Column, k: int = 3) -> DataFrame:
    """Groups of k words by the times of the words themselves: keys, grp, text, a, b. `position`: a non-decreasing function of the order."""
    numbered = scan(words, keys, order, position, nth=row_number()).withColumn("grp", F.floor((F.col("nth") - 1) / k))
    return numbered.groupBy(*keys, "grp").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
