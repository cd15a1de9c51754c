"""Chapters of a video: where to cut, which to join, what each may take, and how long its windows become.

Times are integer milliseconds. A chapter row is keys, chapter, c0, c1; `chunk` and `bucket` as in `intervals`.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from reelgrid.operators.coupled import coupled_moves
from reelgrid.operators.folds import fold_runs, unfold_runs
from reelgrid.operators.intervals import islands, merge_ranges, subtract_ranges, top_per_key
from reelgrid.operators.joins import edge_within, points_in_spans, snap
from reelgrid.operators.scan import last_value, next_value, row_number, running_sum, scan, time_chunk
from reelgrid.operators.transcripts import window_speech
from reelgrid.session import checkpointed


def split_chapters(sentences: DataFrame, videos: DataFrame, keys: list[str], chunk: int, reach: int = 15_000,
                   shortest: int = 20_000) -> DataFrame:
    """`k` chapters of about equally many sentences; `videos`: keys, k, duration.

    A cut lies in the middle between two sentence centres, or at equal times where a video has fewer sentences than chapters. It moves to
    the nearest sentence edge within `reach` unless that leaves less than `shortest` before or behind it; chapters under `shortest` go.
    """
    centre = F.col("start_ms") + F.col("end_ms")                                         # twice the centre
    ranked = scan(sentences.select(*keys, "idx", centre.alias("mid")), keys, ["mid", "idx"], time_chunk("mid", 2 * chunk),
                  nth=row_number(), after=next_value(F.col("mid")))
    counts = sentences.groupBy(*keys).agg(F.count("*").alias("n"))
    sized = videos.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cuts = sized.filter((F.col("k") > 1) & (F.col("duration") > 0)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k") - 1)))
    at = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.rint(F.col("n") * F.col("i") / F.col("k")).cast("long")))
    by_count = cuts.filter("n >= k").withColumn("nth", at)
    placed = (by_count.join(ranked.select(*keys, "nth", "mid", "after"), [*keys, "nth"])
              .withColumn("raw", F.floor((F.col("mid") + F.col("after")) / 4)))
    by_time = cuts.filter("n < k").withColumn("raw", F.floor(F.col("duration") * F.col("i") / F.col("k")))
    raw = checkpointed(placed.select(*keys, "i", "duration", "raw").unionByName(by_time.select(*keys, "i", "duration", "raw")))

    edges = sentences.select(*keys, F.explode(F.array("start_ms", "end_ms")).alias("edge_ms"))
    near = snap(raw, edges, keys, "raw", "edge_ms", reach, chunk, "near")
    # a video has a handful of cuts: from here on its rows are its cuts, not its sentences

    def allowed(before: Column) -> Column:
        return (F.col("near") - before >= shortest) & (F.col("duration") - F.col("near") >= shortest)

    bounds = coupled_moves(near, keys, "i", "raw", "near", allowed, F.lit(0).cast("long"), "t").select(*keys, "i", "t")
    order = W.partitionBy(*keys).orderBy("i")
    ends = (bounds.unionByName(videos.select(*keys, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("t")))
            .unionByName(videos.select(*keys, F.greatest("k", F.lit(1)).cast("long").alias("i"), F.col("duration").alias("t"))))
    spans = (ends.withColumn("c0", F.lag("t").over(order)).filter("i > 0")
             .select(*keys, F.col("i").alias("chapter"), "c0", F.col("t").alias("c1")))
    long = spans.filter(F.col("c1") - F.col("c0") >= shortest)
    whole = (videos.join(long.select(*keys).distinct(), keys, "left_anti")
             .select(*keys, F.lit(1).cast("long").alias("chapter"), F.lit(0).cast("long").alias("c0"), F.col("duration").alias("c1")))
    return long.unionByName(whole)


def merge_sparse_chapters(chapters: DataFrame, sentences: DataFrame, keys: list[str], chunk: int, least: int = 3, slack: int = 10) -> DataFrame:
    """Chapters with fewer than `least` sentences join the neighbour with fewer of them (the left one on ties), first
    ones first, until `min_keep` are left. `chapters` also has min_keep.

    Sentences are counted by the ranks of their centres at the chapter's ends, which merging keeps; a merged chapter has the count of its
    outer ends. All chapters left of the one looked at are full or final, so one pass with one neighbour on each side decides all.
    """
    marks = sentences.select(*keys, (F.col("start_ms") + F.col("end_ms")).alias("t")).groupBy(*keys, "t").agg(F.count("*").alias("here"))
    asked = chapters.select(*keys, "c0", "c1", "min_keep", F.explode(F.array(2 * (F.col("c0") - slack) - 1, 2 * (F.col("c1") + slack))).alias("t"))
    stream = marks.withColumn("c0", F.lit(-1).cast("long")).unionByName(asked, allowMissingColumns=True)   # centres before bounds of the same time
    counted = scan(stream, keys, ["t", "c0"], time_chunk("t", 2 * chunk), upto=running_sum(F.coalesce("here", F.lit(0))))
    ranked = (counted.filter("c1 is not null").groupBy(*keys, "c0", "c1", "min_keep")
              .agg(F.min("upto").alias("lo"), F.max("upto").alias("hi")))
    sizes = chapters.groupBy(*keys).agg(F.count("*").alias("total"))

    def start() -> dict:
        return dict(left=None, now=None, spare=None)

    def settle(s: dict, right: tuple | None) -> list:
        """Decides the chapter looked at; `right` is the next one, if any. Chapters: c0, c1, lo, hi."""
        out = []
        while s["now"]:
            c0, c1, lo, hi = s["now"]
            if hi - lo >= least or s["spare"] <= 0 or not (s["left"] or right):
                if s["left"]:
                    out.append(s["left"][:2])
                s["left"], s["now"] = s["now"], right
                return out
            s["spare"] -= 1
            if s["left"] and (not right or s["left"][3] - s["left"][2] <= right[3] - right[2]):
                s["left"] = (s["left"][0], c1, s["left"][2], hi)
                s["now"] = right
                # the left one was full or final, and it only grew
                return out
            s["now"] = (c0, right[1], lo, right[3])
            return out
        s["now"] = right
        return out

    def step(s: dict, c0: int, c1: int, lo: int, hi: int, total: int, keep: int) -> list:
        if s["spare"] is None:
            s["spare"] = total - max(1, keep)
        return settle(s, (c0, c1, lo, hi))

    def finish(s: dict) -> list:
        out = settle(s, None)
        return out + [x[:2] for x in (s["left"], s["now"]) if x]

    return unfold_runs(ranked.join(sizes, keys), keys, ["c0"], ["c0", "c1", "lo", "hi", "total", "min_keep"], "c0 long, c1 long", start, step, finish)


def used_pass(windows: DataFrame, used: DataFrame, keys: list[str], chapter: str, chunk: int, bucket: int, gap: int = 500,
              shortest: int = 3000) -> DataFrame:
    """What each chapter takes of its windows, chapters in order: no second is taken twice, with `gap` between takers.

    `used` is taken before all chapters. Pieces under `shortest` are not taken and stay free for later chapters. Windows that lie further apart
    than two gaps cannot meet, so each connected run is allotted alone; its state is the sorted list of what was taken in it.
    """
    own = merge_ranges(windows, [*keys, chapter], "s_ms", "e_ms", chunk)
    free = subtract_ranges(checkpointed(own), used, keys, "s_ms", "e_ms", "us", "ue", chunk, bucket, gap, shortest).select(
        *keys, chapter, F.col("piece_s").alias("s_ms"), F.col("piece_e").alias("e_ms"))
    free = checkpointed(free)
    runs = islands(free, keys, "s_ms", "e_ms", chunk, 2 * gap).select(*keys, "s_ms", "island")
    marked = free.join(runs, [*keys, "s_ms"])

    def start() -> dict:
        return dict(taken=[], now=None, fresh=[])

    def close(s: dict) -> None:
        for piece in s["fresh"]:
            insort(s["taken"], piece)
        s["fresh"] = []

    def step(s: dict, c: int, ws: int, we: int) -> list:
        if c != s["now"]:                                  # a chapter does not stand in its own way
            close(s)
            s["now"] = c
        out, at = [], ws
        taken = s["taken"]                                 # sorted and apart, so starts and ends both rise
        i = max(0, bisect_left(taken, (ws,)) - 1)
        while i < len(taken) and taken[i][0] - gap < we:
            b0, b1 = taken[i][0] - gap, taken[i][1] + gap
            if b1 > at:
                if b0 - at >= shortest:
                    out.append((c, at, b0))
                at = max(at, b1)
            i += 1
        if we - at >= shortest:
            out.append((c, at, we))
        s["fresh"] += [(a, b) for _, a, b in out]
        return out

    made = unfold_runs(marked, [*keys, "island"], [chapter, "s_ms"], [chapter, "s_ms", "e_ms"], f"{chapter} long, s_ms long, e_ms long",
                       start, step, lambda s: [])
    return made.drop("island")


def fit_chapters(windows: DataFrame, chapters: DataFrame, used: DataFrame, edges: DataFrame, keys: list[str], chapter: str, low: int, high: int,
                 chunk: int, bucket: int, gap: int = 500, shortest: int = 3000) -> DataFrame:
    """Total window length of each chapter brought into [low, high]: one row a chapter with first_s, last_e, total, reason.

    Too long: the windows in order while they fit; the one that does not ends at an earlier edge, or goes if under `shortest` is left. Too short:
    the last window grows to an edge inside the chapter, then the first one backwards, then the last one up to the end of the video;
    none grows into a used range or nearer than `gap` to it. `chapters`: keys, chapter, c0, c1, duration; windows of a chapter do not meet
    and are read several times. Windows that `subtract_ranges` made with walls bring them along.
    """
    group = [*keys, chapter]
    size = F.col("e_ms") - F.col("s_ms")
    walled = ["floor", "wall"] if {"floor", "wall"} <= set(windows.columns) else []
    totals = [F.min("s_ms").alias("first_s"), F.max("e_ms").alias("last_e"), F.sum(size).alias("total"),
              *([F.min_by("floor", "s_ms").alias("floor"), F.max_by("wall", "s_ms").alias("wall")] if walled else [])]
    sums = windows.groupBy(*group).agg(*totals)
    too_long = F.col("total") > high + 1000
    # only the windows of chapters that are too long are walked
    long = windows.join(sums.filter(too_long).select(*group), group, "left_semi")
    asked = (scan(long, group, ["s_ms"], time_chunk("s_ms", chunk), before=running_sum(size, False))
             .withColumn("fits", F.col("before") + size <= high).withColumn("cut", F.col("s_ms") + high - F.col("before")))
    crossing = edge_within(asked.filter("not fits").filter(F.col("before") < high - 10), edges, keys, [chapter, "s_ms"], "edge_ms",
                           F.col("cut") - 2000, F.col("cut") + 50, bucket, "edge", False)
    cut = (crossing.withColumn("e_ms", F.coalesce("edge", "cut")).filter(F.col("e_ms") - F.col("s_ms") >= shortest)
           .select(*group, "s_ms", "e_ms", *walled))
    kept = asked.filter(F.col("fits") & (F.col("before") < high - 10)).select(*group, "s_ms", "e_ms", *walled).unionByName(cut)
    first = asked.filter("before = 0").select(*group, "s_ms", "e_ms", *walled).withColumn("spare", F.lit(True))
    some = kept.withColumn("spare", F.lit(False)).unionByName(first)          # the first window stands in where none is kept
    both = some.groupBy(*group, "spare").agg(*totals)
    told = F.struct("first_s", "last_e", "total", *walled)
    shortened = both.groupBy(*group).agg(F.min_by(told, "spare").alias("x")).select(*group, "x.*")
    rows = (sums.filter(~too_long).withColumn("over", F.lit(False)).unionByName(shortened.withColumn("over", F.lit(True)))
            .join(chapters, group))
    if not walled:
        rows = checkpointed(rows)
        rows = rows.join(_walls(rows, used, keys, chapter, chunk, gap), group)
    rows = checkpointed(rows.withColumn("asked", F.col("total") < low - 1000))

    # No end grows by more than what is missing and three seconds to an edge, so the edges that may matter are known beforehand.
    room = F.lit(low) - F.col("total") + 3000
    reach = F.array(F.struct(F.lit(True).alias("back"), (F.col("first_s") - room).alias("lo"), (F.col("first_s") + 50).alias("hi")),
                    F.struct(F.lit(False).alias("back"), (F.col("last_e") - 50).alias("lo"), (F.col("last_e") + room).alias("hi")))
    spans = rows.filter("asked").select(*group, F.explode(reach).alias("x")).select(*group, "x.*")
    marks = edges.select(*keys, F.col("edge_ms").alias("t")).distinct()
    met = points_in_spans(marks, spans, keys, "t", ("lo", "hi"), bucket, "both")
    near = met.groupBy(*group).agg(F.collect_set(F.when(F.col("back"), F.col("t"))).alias("behind"),
                                   F.collect_set(F.when(~F.col("back"), F.col("t"))).alias("ahead"))

    def grown(df: DataFrame, hard: Column, when: Column, back: bool) -> DataFrame:
        """One end grows by what is missing, up to the furthest edge within three seconds more."""
        edge, sign = ("first_s", -1) if back else ("last_e", 1)
        here = F.col(edge)
        if back:
            stop = F.least(here, F.greatest(hard, F.coalesce("floor", hard)))
        else:
            stop = F.greatest(here, F.least(hard, F.coalesce("wall", hard)))
        add = F.when(when, F.greatest(F.lit(0), F.least(sign * (stop - here), F.lit(low) - F.col("total")))).otherwise(0)
        df = df.withColumn("stop", stop).withColumn("add", add).withColumn("want", here + sign * F.col("add"))
        lo, hi = (F.col("want") - 3000, F.col("want") + 50) if back else (F.col("want") - 50, F.col("want") + 3000)
        inside = F.filter("behind" if back else "ahead", lambda x: (x >= lo) & (x <= hi))
        best = F.coalesce(F.array_min(inside) if back else F.array_max(inside), "want")
        to = F.when(F.col("add") > 50, F.greatest("stop", best) if back else F.least("stop", best)).otherwise(here)
        return (df.withColumn("to", to).withColumn("total", F.col("total") + sign * (F.col("to") - here)).withColumn(edge, F.col("to"))
                .drop("stop", "add", "want", "to"))

    missing = F.col("asked") & (F.lit(low) - F.col("total") > 500)
    out = grown(rows.join(near, group, "left"), F.col("c1"), F.col("asked"), False)
    out = grown(out, F.col("c0"), missing, True)
    out = grown(out, F.col("duration"), missing, False)
    reason = F.when(F.col("over"), "cut").when(~F.col("asked"), "kept").when(F.col("total") < low - 1000, "short").otherwise("stretched")
    return out.select(*group, "first_s", "last_e", "total", reason.alias("reason"))


def _walls(rows: DataFrame, used: DataFrame, keys: list[str], chapter: str, chunk: int, gap: int) -> DataFrame:
    """keys, chapter, floor, wall: where the used range before first_s ends and the one behind last_e begins, both widened by `gap`."""
    merged = merge_ranges(used, keys, "us", "ue", chunk)
    at = rows.select(*keys, chapter, F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("first_s").alias("t")),
                                                       F.struct(F.lit(2).alias("kind"), F.col("last_e").alias("t")))).alias("x")).select(*keys, chapter, "x.*")
    walls = merged.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("ue") + gap).alias("t")),
                                                   F.struct(F.lit(3).alias("kind"), (F.col("us") - gap).alias("t")))).alias("x")).select(*keys, "x.*")
    seen = scan(at.unionByName(walls, allowMissingColumns=True), keys, ["t", "kind", chapter], time_chunk("t", chunk),
                floor=last_value(F.when(F.col("kind") == 0, F.col("t"))), wall=next_value(F.when(F.col("kind") == 3, F.col("t"))))
    return (seen.filter("kind in (1, 2)").groupBy(*keys, chapter)
            .agg(F.max(F.when(F.col("kind") == 1, F.col("floor"))).alias("floor"), F.max(F.when(F.col("kind") == 2, F.col("wall"))).alias("wall")))


def validate_windows(windows: DataFrame, videos: DataFrame, sentences: DataFrame, keys: list[str], group: str, chunk: int, bucket: int,
                     low: int = 0, high: int = 0, most: int = 6, shortest: int = 6000, longest: int = 45_000) -> DataFrame:
    """Clean windows of each script: keys, group, s_ms, e_ms; a script that is rejected has none.

    Windows are clamped to the video, cut to `longest`, pushed behind the one before and dropped under `shortest`. Windows with over 30 % junk
    words go, those with under 1.2 words a second too unless alone. The `most` longest stay, in time order, up to `high` in all.
    A single window must last 20 s or 60 % of `low`, several of them 60 % of `low` together. `sentences` as scored, `videos`: keys, duration.
    """
    of = [*keys, group]
    dur = F.col("duration")
    a = F.least(F.greatest(F.col("s_ms"), F.lit(0)), F.when(dur > 0, dur).otherwise(F.greatest(F.col("s_ms"), F.lit(0))))
    b = F.when(dur > 0, F.least("e_ms", dur)).otherwise(F.col("e_ms"))
    clean = (windows.join(videos, keys).select(*of, a.alias("s_ms"), b.alias("e_ms")).withColumn("e_ms", F.least("e_ms", F.col("s_ms") + longest))
             .filter(F.col("e_ms") - F.col("s_ms") >= shortest))
    # windows that no other one reaches push nobody: each connected run is walked alone
    clean = checkpointed(clean)
    runs = islands(clean, of, "s_ms", "e_ms", chunk).select(*of, "s_ms", "island")

    def push(state: dict, s: int, e: int) -> int:
        start = max(s, state.get("end", s))
        if e - start < shortest:
            return -1
        state["end"] = e
        return start

    pushed = (fold_runs(clean.join(runs, [*of, "s_ms"]), [*of, "island"], ["s_ms", "e_ms"], ["s_ms", "e_ms"], dict, push, "start", T.LongType())
              .filter("start >= 0").select(*of, F.col("start").alias("s_ms"), "e_ms"))
    pushed = checkpointed(pushed.withColumn("win", F.col("s_ms")))             # starts are unique in a script now
    heard = window_speech(pushed, sentences, keys, [group, "win"], "s_ms", "e_ms", bucket).select(*of, "win", "junk_ratio", "density")
    many = pushed.groupBy(*of).agg(F.count("*").alias("n"))
    good = (pushed.join(heard, [*of, "win"]).join(many, of)
            .filter((F.round("junk_ratio", 6) <= 0.30) & ((F.round("density", 6) >= 1.2) | (F.col("n") <= 1))))
    top = top_per_key(good, of, [F.desc(F.col("e_ms") - F.col("s_ms")), F.asc("s_ms")], most)
    # a script has a handful of windows from here on
    order = W.partitionBy(*of).orderBy("s_ms").rowsBetween(W.unboundedPreceding, -1)
    size = F.col("e_ms") - F.col("s_ms")
    kept = top.select(*of, "s_ms", "e_ms")
    if high > 0:
        before = F.coalesce(F.sum(size).over(order), F.lit(0))
        kept = (kept.withColumn("before", before).filter(F.col("before") < high - 10)
                .withColumn("e_ms", F.least("e_ms", F.col("s_ms") + high - F.col("before")))
                .withColumn("whole", F.col("e_ms") - F.col("s_ms") >= shortest).filter("whole").drop("before", "whole"))
    whole = W.partitionBy(*of)
    need = F.when(F.col("n") == 1, F.lit(max(20_000, low * 6 // 10))).otherwise(F.lit(low * 6 // 10))
    return (kept.withColumn("n", F.count("*").over(whole)).withColumn("total", F.sum(size).over(whole))
            .filter(F.col("total") >= need).select(*of, "s_ms", "e_ms"))
