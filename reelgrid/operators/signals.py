"""Per-second signals: islands, peaks, quantiles by position, surprise and kinds of moments.

Signals have one row per (key, second); `chunk` is a number of seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from reelgrid.operators.intervals import islands, min_spacing, top_per_key
from reelgrid.operators.scan import running_sum, scan, time_chunk


def with_halo(df: DataFrame, pos: str, width: int, before: int, after: int) -> DataFrame:
    """Each row in its chunk of the series and, as a neighbour (`own` false), in the chunks whose
    frames of `before` rows back and `after` rows ahead reach it. Bounded frames then need no
    window over a whole key."""
    p = F.col(pos)
    home = F.floor(p / F.lit(width))
    spread = F.sequence(F.floor((p - after) / F.lit(width)), F.floor((p + before) / F.lit(width)))
    return (df.withColumn("__home", home).withColumn("__cell", F.explode(spread))
            .withColumn("own", F.col("__cell") == F.col("__home")).drop("__home"))


def frame(keys: list[str], pos: str, low: int, high: int) -> W:
    """Frame of neighbouring positions inside a halo chunk."""
    return W.partitionBy(*keys, "__cell").orderBy(pos).rangeBetween(low, high)


def nth_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[Column, Column]],
               chunk: int) -> DataFrame:
    """Values at given positions of the sorted list of each key, without sorting a whole key.

    Rows are counted per distinct value first. `ranks[name]` = position as a function of `n`,
    the row count of the key (a column named `n`), given as a column.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    totals = df.groupBy(*keys).agg(F.count("*").alias("n"))
    run = scan(counts, keys, [value], F.floor(F.col(value) / F.lit(chunk)),
               __upto=running_sum(F.col("__c"))).join(totals, keys)
    def at(rank: Column) -> Column:
        return (F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank)
    return run.groupBy(*keys).agg(*[F.max(F.when(at(r), F.col(value))).alias(name)
                                    for name, r in ranks.items()])


def loud_islands(signal: DataFrame, keys: list[str], chunk: int, num: int = 16, den: int = 10,
                 top: int = 12) -> DataFrame:
    """Runs of seconds at least num/den times the mean loudness; the loudest `top` per key."""
    mean = signal.groupBy(*keys).agg(F.sum("rms").alias("total"), F.count("*").alias("n"))
    loud = (signal.join(mean.filter("total > 0"), keys)
            .filter(F.col("rms") * F.col("n") * den >= F.col("total") * num)
            .withColumn("next", F.col("sec") + 1))
    runs = islands(loud, keys, "sec", "next", chunk, extra=[F.sum("rms").alias("rms")])
    ratio = (F.col("loudness") / F.col("seconds")) / (F.col("total") / F.col("n"))
    found = (runs.groupBy(*keys, "island")
             .agg(F.max("next").alias("to_sec"), F.sum("rms").alias("loudness"), F.count("*").alias("seconds"))
             .join(mean, keys)
             .select(*keys, F.col("island").alias("from_sec"), "to_sec", F.round(ratio, 2).alias("ratio")))
    return top_per_key(found, keys, [F.col("ratio").desc(), F.col("from_sec")], top)


def silent_action_islands(signal: DataFrame, sentences: DataFrame, keys: list[str], chunk: int,
                          shortest: int = 2, top: int = 8) -> DataFrame:
    """Runs of strong motion without speech, at least `shortest` seconds long."""
    n = F.col("n")
    q = nth_values(signal, keys, "motion", {
        "p20": F.greatest(F.lit(0), F.floor(n * 20 / 100) - 1),
        "p90": F.least(n - 1, F.floor(n * 90 / 100))}, 16)
    mean = signal.groupBy(*keys).agg(F.sum("motion").alias("total"), F.count("*").alias("n"))
    bar = F.col("p20") * 10 + F.greatest(F.lit(0), F.col("p90") - F.col("p20")) * 4
    strong = F.when(bar > 0, F.col("motion") * 10 >= bar).otherwise(F.col("motion") * n >= F.col("total"))
    spoken = sentences.select(*keys, F.explode(F.sequence(
        F.floor(F.col("start_ms") / 1000), F.floor(F.col("end_ms") / 1000))).alias("sec")).distinct()
    live = (signal.join(mean.filter("total > 0"), keys).join(q, keys).filter(strong)
            .join(spoken, [*keys, "sec"], "left_anti").withColumn("next", F.col("sec") + 1))
    runs = islands(live, keys, "sec", "next", chunk, extra=[F.sum("motion").alias("motion")])
    ratio = (F.col("moved") / F.col("seconds")) / (F.col("total") / F.col("n"))
    found = (runs.groupBy(*keys, "island")
             .agg(F.max("next").alias("to_sec"), F.sum("motion").alias("moved"), F.count("*").alias("seconds"))
             .filter(F.col("seconds") >= shortest).join(mean, keys)
             .select(*keys, F.col("island").alias("from_sec"), "to_sec", F.round(ratio, 2).alias("ratio")))
    return top_per_key(found, keys, [F.col("ratio").desc(), F.col("from_sec")], top)


def silence_islands(signal: DataFrame, keys: list[str], chunk: int, percent: int = 6,
                    samples: int = 4) -> DataFrame:
    """Runs of at least `samples` samples below `percent` of the loudest one."""
    peak = signal.groupBy(*keys).agg(F.max("rms").alias("peak"))
    quiet = (signal.join(peak, keys).filter(F.col("rms") * 100 < F.col("peak") * percent)
             .withColumn("next", F.col("sec") + 1))
    return (islands(quiet, keys, "sec", "next", chunk).groupBy(*keys, "island")
            .agg(F.max("next").alias("to_sec")).filter(F.col("to_sec") - F.col("island") >= samples)
            .withColumnRenamed("island", "from_sec"))


def local_peaks(signal: DataFrame, keys: list[str], chunk: int, wait: int = 10) -> DataFrame:
    """Samples that are the maximum around them and stand out by 15 % of the peak, spaced apart."""
    peak = signal.groupBy(*keys).agg(F.max("rms").alias("peak"))
    halo = with_halo(signal.join(peak, keys), "sec", chunk, 40, 40)
    near, wide = frame(keys, "sec", -20, 19), frame(keys, "sec", -40, 39)
    seen = halo.select(*keys, "sec", "rms", "own", "peak", F.max("rms").over(near).alias("top"),
                       F.sum("rms").over(wide).alias("s"), F.count("*").over(wide).alias("c"))
    found = seen.filter(F.col("own") & (F.col("rms") == F.col("top"))
                        & (F.col("rms") * F.col("c") * 20 >= F.col("s") * 20 + F.col("peak") * F.col("c") * 3))
    return min_spacing(found.select(*keys, "sec", "rms"), keys, "sec", ["rms"], wait + 1, chunk)


def medians(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of both signals; the state is one count per distinct value."""
    return signal.groupBy(*keys).agg(F.expr("percentile(rms, 0.5)").alias("med_rms"),
                                     F.expr("percentile(motion, 0.5)").alias("med_motion"),
                                     F.max("rms").alias("max_rms"), F.max("motion").alias("max_motion"),
                                     F.count("*").alias("n"), F.max("sec").alias("last_sec"))


def surprise(signal: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Score of each second: loudness and motion over their medians, plus a jump bonus."""
    halo = with_halo(signal.join(medians(signal, keys), keys), "sec", chunk, 3, 0)
    recent = F.coalesce(F.expr("percentile(rms, 0.5)").over(frame(keys, "sec", -3, -1)), F.lit(0.0))
    base = F.when(F.col("med_rms") == 0, 1e-6).otherwise(F.col("med_rms"))
    base_m = F.when(F.col("med_motion") == 0, 1e-6).otherwise(F.col("med_motion"))
    jump = F.greatest(F.lit(0.0), (F.col("rms") - F.col("recent")) / base)
    return (halo.withColumn("recent", recent).filter("own")
            .select(*keys, "sec", "rms", "motion", "med_rms", "med_motion", "last_sec",
                    (F.col("rms") / base + F.col("motion") / base_m + 1.5 * jump).alias("score")))


def moment_kind(rms: Column, motion: Column, med_rms: Column, med_motion: Column, sec: Column,
                total: Column, at_join: Column) -> Column:
    """What a second is, the first rule that fits."""
    return (F.when(at_join, "join").when(sec >= total - 3, "close")
            .when(motion <= med_motion * 0.55, "still")
            .when((med_rms > 0) & (rms >= med_rms * 1.7), "peak")
            .when((med_motion > 0) & (motion >= med_motion * 1.5), "action").otherwise("plain"))


def loudest_hook(signal: DataFrame, segs: DataFrame, keys: list[str], clip: list[str], chunk: int,
                 length: int = 3) -> DataFrame:
    """The loudest `length` seconds inside a clip's segments; the first on ties."""
    halo = with_halo(signal, "sec", chunk, 0, length - 1)
    ahead = frame(keys, "sec", 0, length - 1)
    sums = (halo.select(*keys, "sec", "own", F.sum("rms").over(ahead).alias("loud"),
                        F.count("*").over(ahead).alias("c"))
            .filter(F.col("own") & (F.col("c") == length)))
    first = F.floor(F.col("s_ms") / 1000)
    last = F.greatest(first, F.floor(F.col("e_ms") / 1000) - length)
    starts = segs.select(*keys, *clip, "seg_idx", F.explode(F.sequence(first, last)).alias("sec"))
    return (starts.join(sums, [*keys, "sec"]).groupBy(*keys, *clip)
            .agg(F.max_by("sec", F.struct("loud", -F.col("seg_idx"), -F.col("sec"))).alias("hook_sec"),
                 F.max("loud").alias("loud")))


def audio_base(signal: DataFrame, windows: DataFrame, keys: list[str], win: list[str],
               s: str, e: str, bucket: int) -> DataFrame:
    """Mean and maximum of the samples in [s, e) seconds of each window, joined on seconds."""
    from reelgrid.operators.joins import points_in_spans
    w = windows.select(*keys, *win, s, e)
    return (points_in_spans(signal.select(*keys, "sec", "rms"), w, keys, "sec", (s, e), bucket)
            .groupBy(*keys, *win).agg(F.sum("rms").alias("rms_sum"), F.count("*").alias("rms_n"),
                                      F.max("rms").alias("rms_max")))


def scene_score(n: Column) -> Column:
    """Score by number of cuts inside a window: one to three are best."""
    return (F.when(n == 0, 45.0).when(n <= 3, 70.0 + n * 5)
            .otherwise(F.greatest(F.lit(50.0), 85.0 - (n - 3) * 5)))


def speech_from_silence(silences: DataFrame, keys: list[str], s: str, e: str, total: int,
                        chunk: int, tiny: int = 50, shortest: int = 120) -> DataFrame:
    """Where it is not silent between 0 and `total`; keys without silence have no rows."""
    from reelgrid.operators.scan import running_max
    cut = silences.select(*keys, F.least(F.greatest(F.col(s), F.lit(0)), F.lit(total)).alias("a"),
                          F.least(F.greatest(F.col(e), F.lit(0)), F.lit(total)).alias("b"))
    cut = cut.groupBy(*keys, "a").agg(F.max("b").alias("b"))
    gaps = (scan(cut, keys, ["a"], time_chunk("a", chunk), cur=running_max(F.col("b"), False))
            .select(*keys, F.coalesce("cur", F.lit(0)).alias("start_ms"), F.col("a").alias("end_ms")))
    tail = cut.groupBy(*keys).agg(F.max("b").alias("start_ms")).withColumn("end_ms", F.lit(total).cast("long"))
    length = F.col("end_ms") - F.col("start_ms")
    return gaps.unionByName(tail).filter((length > tiny) & (length >= shortest))


def fallback_hook(signal: DataFrame, segs: DataFrame, clips: DataFrame, keys: list[str], clip: list[str], chunk: int, bucket: int, length: int = 2500,
                  away: int = 3000, longest: int = 4000) -> DataFrame:
    """The teaser of each clip: keys, clip, hook_s, hook_e; null where there is none.

    A hook that the clip brings along (`clips`: keys, clip, hook_s, hook_e, nulls allowed) stays, cut to `longest`, if it lasts a second and begins more than
    `away` from the clip's start; else there is none. Without one, the loudest window of `length` that begins a whole number of seconds after a
    segment's start wins, the first on ties, under the same rule. All windows of a segment span the same number of samples, two or three, so
    their scores are bounded frames over the series: no window is spelled out, and seconds meet segments as points in spans.
    """
    few, many = length // 1000, -(-length // 1000)
    halo = with_halo(signal.select(*keys, "sec", "rms"), "sec", chunk, 0, many - 1)

    def loud(n: int) -> Column:
        ahead = frame(keys, "sec", 0, n - 1)
        return F.round(F.least(F.lit(100.0), (6 * F.sum("rms").over(ahead) / F.count("*").over(ahead) + 4 * F.max("rms").over(ahead)) / 100), 4)

    scored = halo.select(*keys, "sec", "own", loud(few).alias("low"), loud(many).alias("high")).filter("own").drop("own")
    count = F.floor((F.col("e_ms") - F.col("s_ms") - length) / 1000)               # windows after the first one
    first = F.floor(F.col("s_ms") / 1000)
    spans = (segs.filter(F.col("e_ms") - F.col("s_ms") >= length)
             .select(*keys, *clip, "seg_idx", "s_ms", first.alias("c0"), (first + count).alias("c1"),
                     ((F.col("s_ms") + length) / 1000 - first >= many).alias("wide")))
    from reelgrid.operators.joins import points_in_spans
    seen = points_in_spans(scored, spans, keys, "sec", ("c0", "c1"), bucket, "both")
    heard = seen.select(*keys, *clip, "seg_idx", (F.col("s_ms") + (F.col("sec") - F.col("c0")) * 1000).alias("t"),
                        F.when(F.col("wide"), F.col("high")).otherwise(F.col("low")).alias("score"))
    silent = spans.select(*keys, *clip, "seg_idx", F.col("s_ms").alias("t"), F.lit(0.0).alias("score"))       # nothing heard: the first window
    best = (heard.unionByName(silent).groupBy(*keys, *clip)
            .agg(F.max_by("t", F.struct("score", -F.col("seg_idx"), -F.col("t"))).alias("best")))
    starts = segs.groupBy(*keys, *clip).agg(F.min_by("s_ms", "seg_idx").alias("first_s"))
    told = clips.join(starts, [*keys, *clip]).join(best, [*keys, *clip], "left")
    given = F.col("hook_s").isNotNull() & F.col("hook_e").isNotNull()
    keeps = given & (F.col("hook_e") - F.col("hook_s") >= 1000) & (F.abs(F.col("hook_s") - F.col("first_s")) > away)
    found = ~given & (F.abs(F.col("best") - F.col("first_s")) > away)
    return told.select(*keys, *clip, F.when(keeps, F.col("hook_s")).when(found, F.col("best")).alias("hook_s2"),
                       F.when(keeps, F.least("hook_e", F.col("hook_s") + longest)).when(found, F.col("best") + length).alias("hook_e2")).withColumnsRenamed(
        {"hook_s2": "hook_s", "hook_e2": "hook_e"})
