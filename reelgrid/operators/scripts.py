"""Narration scripts: parts, joins between segments, labels, titles, replies and listings.

A script is `clip`, idx, start_ms, end_ms, mode (narrate / orig), sfx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from reelgrid.operators.folds import fold_runs
from reelgrid.operators.intervals import min_spacing
from reelgrid.operators.joins import overlap_join, points_in_spans
from reelgrid.operators.scan import last_value, next_value, row_number, running_max, running_sum, scan

# Sound labels a part may carry.
SOUND_LABELS = ["none", "impact", "riser", "transition", "reveal", "pop"]


def _chunk() -> Column:
    return F.floor(F.col("idx") / 512)


def role_changes(parts: DataFrame, clip: list[str]) -> DataFrame:
    """How often a script changes between narration and original sound, and its narrated share."""
    prev = scan(parts, clip, ["idx"], _chunk(), __m=last_value(F.col("mode"), False))
    length = F.col("end_ms") - F.col("start_ms")
    return prev.groupBy(*clip).agg(
        F.count_if(F.coalesce(F.col("__m") != F.col("mode"), F.lit(False))).alias("changes"),
        F.sum(F.when(F.col("mode") == "narrate", length).otherwise(0)).alias("narrated_ms"), F.sum(length).alias("total_ms"))


def join_kinds(segs: DataFrame, clip: list[str]) -> DataFrame:
    """Sound of the join after each segment by where the next one begins and how long it is."""
    nxt = scan(segs, clip, ["idx"], _chunk(), __s=next_value(F.col("start_ms")), __e=next_value(F.col("end_ms")), __n=row_number())
    last = segs.groupBy(*clip).agg(F.count("*").alias("__all"))
    jump = F.col("__s") - F.col("end_ms")
    kind = (F.when(jump < -50, "impact").when(jump <= 1200, "pop").when(F.col("__e") - F.col("__s") < 2500, "impact").otherwise("transition"))
    rows = nxt.filter("__s is not null").join(last, clip).withColumn("kind", kind)
    final = (F.col("__n") == F.col("__all") - 1) & (F.col("__all") >= 3) & (F.col("kind") == "transition")
    return rows.select(*clip, "idx", F.when(final, "reveal").otherwise(F.col("kind")).alias("kind"))


def narrated_join_kinds(segs: DataFrame, parts: DataFrame, clip: list[str], bucket: int) -> DataFrame:
    """Sound of the join after each segment of a narrated clip: clip, idx, kind.

    The valid label of the part where the next segment begins wins, `none` included. Without one, the last join reveals, a part with original
    sound hits, the first narrated one rises, and the others are transitions.
    """
    nxt = scan(segs, clip, ["idx"], _chunk(), at_ms=next_value(F.col("start_ms")), __after=next_value(F.col("idx")))
    last = segs.groupBy(*clip).agg(F.max("idx").alias("__last"))
    joins = nxt.filter("at_ms is not null").join(last, clip).select(*clip, "idx", "at_ms", (F.col("__after") == F.col("__last")).alias("__final"))
    held = script_part_at(joins.select(*clip, "at_ms").distinct(), parts, clip, "at_ms", bucket)
    seen = joins.join(held, [*clip, "at_ms"], "left")
    fresh = F.col("sfx").isNull() & ~F.col("__final") & F.coalesce(F.col("mode") == "narrate", F.lit(False))
    ranked = scan(seen.withColumn("__told", fresh.cast("long")), clip, ["idx"], _chunk(), __turn=running_sum(F.col("__told")))
    kind = (F.when(F.col("sfx").isNotNull(), F.col("sfx")).when(F.col("__final"), "reveal").when(F.col("mode") == "orig", "impact")
            .when((F.col("__told") == 1) & (F.col("__turn") == 1), "riser").otherwise("transition"))
    return ranked.select(*clip, "idx", kind.alias("kind"))


def climax_joins(kinds: DataFrame, segs: DataFrame, climax: DataFrame, clip: list[str]) -> DataFrame:
    """`join_kinds` with the join into the climax stressed: an impact where it is the best of several moments (`mixed`), else an impact or a riser,
    settled by the clip's name. `climax`: clip, idx of its segment, mixed; a climax in the first segment has no join before it."""
    before = scan(segs.select(*clip, "idx"), clip, ["idx"], _chunk(), __into=next_value(F.col("idx")))
    top = climax.select(*clip, F.col("idx").alias("__into"), "mixed")
    met = before.join(top, [*clip, "__into"]).select(*clip, "idx", "mixed")
    even = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in clip])), 1, 1), 16, 10).cast("int") % 2 == 0
    stress = F.when(F.col("mixed") | even, "impact").otherwise("riser")
    return kinds.join(met, [*clip, "idx"], "left").select(*clip, "idx", F.when(F.col("mixed").isNull(), F.col("kind")).otherwise(stress).alias("kind"))


def script_part_at(points: DataFrame, parts: DataFrame, keys: list[str], t: str, bucket: int) -> DataFrame:
    """Mode and valid sound label of the part that holds each time; a part starting within 50 ms wins."""
    hit = points_in_spans(points, parts, keys, t, ("start_ms", "end_ms"), bucket, "both", 50)
    x = F.col(t)
    tier = (F.when(((F.col("start_ms") <= x) & (x < F.col("end_ms"))) | (F.abs(F.col("start_ms") - x) < 50), 0)
            .when((F.col("start_ms") <= x) & (x <= F.col("end_ms")), 1))
    ids = [c for c in points.columns]
    best = (hit.withColumn("__t", tier).filter("__t is not null").groupBy(*ids)
            .agg(F.min_by(F.struct("mode", "sfx"), F.struct("__t", "idx")).alias("p")))
    label = F.when(F.col("p.sfx").isin(SOUND_LABELS), F.col("p.sfx"))
    return best.select(*ids, F.col("p.mode").alias("mode"), label.alias("sfx"))


def attach_labels(parts: DataFrame, labels: DataFrame, clip: list[str], chunk: int, bucket: int,
                  reach: int = 2500, gap: int = 7000) -> DataFrame:
    """Parts in order take the nearest unused label that starts within `reach`; then labels closer
    than `gap` to the last kept one are dropped.

    Only label candidates near a part travel to the fold; a script has tens of parts.
    """
    spans = parts.select(*clip, "idx", "start_ms", (F.col("start_ms") - reach + 1).alias("__lo"), (F.col("start_ms") + reach - 1).alias("__hi"))
    near = points_in_spans(labels.select(*clip, "label_no", "at_ms", "label"), spans, clip, "at_ms", ("__lo", "__hi"), bucket, "both")
    near = near.withColumn("__d", F.abs(F.col("at_ms") - F.col("start_ms")))
    opts = near.groupBy(*clip, "idx", "start_ms").agg(F.array_sort(F.collect_list(F.struct("__d", "label_no"))).alias("opts"))

    def step(used: set, options) -> int:
        for o in options:
            if o["label_no"] not in used:
                used.add(o["label_no"])
                return int(o["label_no"])
        return -1

    took = fold_runs(opts, clip, ["idx"], ["opts"], set, step, "label_no", T.LongType()).filter("label_no >= 0")
    named = took.select(*clip, "idx", "start_ms", "label_no").join(labels.select(*clip, "label_no", "label"), [*clip, "label_no"])
    return min_spacing(named.select(*clip, "idx", "start_ms", "label"), clip, "start_ms", ["idx"], gap, chunk)


def tile_parts(parts: DataFrame, clip: list[str], window: DataFrame, shortest: int = 1500, hole: int = 250) -> DataFrame:
    """Parts made to cover their window: overlaps pushed, short parts dropped, holes filled with original
    sound, small holes absorbed, neighbouring original parts joined. `window`: clip, ws, we."""
    rows = (parts.join(window, clip).withColumn("start_ms", F.greatest("start_ms", "ws")).withColumn("end_ms", F.least("end_ms", "we"))
            .filter(F.col("end_ms") - F.col("start_ms") >= shortest))

    def push(state: dict, s: int, e: int) -> int:
        begin = max(s, state.get("end", s))
        if e - begin < shortest:
            return -1
        state["end"] = e
        return begin

    pushed = (fold_runs(rows, clip, ["start_ms", "end_ms", "idx"], ["start_ms", "end_ms"], dict, push, "__s", T.LongType())
              .filter("__s >= 0").withColumn("start_ms", F.col("__s")).drop("__s"))
    seen = scan(pushed.select(*clip, "start_ms", "end_ms", "mode", "ws", "we"), clip, ["start_ms"], F.floor(F.col("start_ms") / 600_000),
                __prev=last_value(F.col("end_ms"), False), __next=next_value(F.col("start_ms")))
    before = F.coalesce("__prev", "ws")
    gap = F.col("start_ms") - before
    tail = F.when(F.col("__next").isNull(), F.col("we") - F.col("end_ms")).otherwise(0)
    body = F.struct(F.when(gap <= hole, before).otherwise(F.col("start_ms")).alias("s"),
                    F.when(tail <= hole, F.col("end_ms") + tail).otherwise(F.col("end_ms")).alias("e"), F.col("mode").alias("m"))
    fill = F.when(gap > hole, F.struct(before.alias("s"), F.col("start_ms").alias("e"), F.lit("orig").alias("m")))
    rest = F.when(tail > hole, F.struct(F.col("end_ms").alias("s"), F.col("we").alias("e"), F.lit("orig").alias("m")))
    tiles = (seen.select(*clip, F.explode(F.filter(F.array(fill, body, rest), lambda x: x.isNotNull())).alias("x"))
             .select(*clip, F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("mode")))
    empty = (window.join(tiles.select(*clip).distinct(), clip, "left_anti")
             .select(*clip, F.col("ws").alias("s"), F.col("we").alias("e"), F.lit("orig").alias("mode")))
    tiles = tiles.unionByName(empty)
    at = F.floor(F.col("s") / 600_000)
    marked = scan(tiles, clip, ["s"], at, __m=last_value(F.col("mode"), False))
    opens = F.when(F.col("__m").isNull() | (F.col("mode") != "orig") | (F.col("__m") != "orig"), F.col("s"))
    runs = scan(marked.withColumn("__o", opens), clip, ["s"], at, run=last_value(F.col("__o")))
    return runs.groupBy(*clip, "run").agg(F.max("e").alias("end_ms"), F.min("mode").alias("mode")).withColumnRenamed("run", "start_ms")


def chapter_count(duration_ms: Column, n_sentences: Column) -> Column:
    """Number of chapters by length, limited by sentences and time per chapter."""
    auto = F.when(duration_ms < 240_000, 1).when(duration_ms <= 720_000, 2).when(duration_ms <= 1_200_000, 3).otherwise(4)
    feasible = F.greatest(F.lit(1), F.least(F.floor(n_sentences / 4), F.floor(duration_ms / 40_000)))
    return F.least(F.greatest(F.lit(1), F.least(F.lit(8), auto)), feasible).cast("long")


def hashtags(tags: Column, most: int) -> Column:
    """Tags as #x without spaces, first occurrences, at most `most`."""
    bare = F.filter(F.transform(tags, lambda t: F.regexp_replace(t, r"[#\s]", "")), lambda t: t != "")
    return F.slice(F.array_distinct(F.transform(bare, lambda t: F.concat(F.lit("#"), t))), 1, most)


def reply_rows(replies: DataFrame, n_items: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of replies: thoughts dropped, first JSON list taken, scores clamped, unknown
    indexes dropped. `replies`: request_id, raw_text and the number of items asked about."""
    bare = F.regexp_replace("raw_text", r"(?s)<think>.*?</think>", "")
    fenced = F.regexp_extract(bare, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(bare)
    listed = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    items = F.from_json(F.nullif(listed, F.lit("")), "array<struct<index:string,idx:string,score:string,reason:string>>")
    parsed = replies.select("request_id", n_items, "raw_text", items.alias("items"))
    i = F.coalesce("x.index", "x.idx").try_cast("bigint")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("x.score").try_cast("double"), F.lit(50.0))))
    rows = (parsed.filter("items is not null").select("request_id", n_items, F.explode("items").alias("x"))
            .select("request_id", i.alias("idx"), score.alias("score"), F.trim(F.coalesce("x.reason", F.lit(""))).alias("reason"), n_items)
            .filter((F.col("idx") >= 0) & (F.col("idx") < F.col(n_items))).drop(n_items))
    return rows, parsed.filter("items is null").select("request_id", "raw_text")


def first_clean_line(clips: DataFrame, sentences: DataFrame, keys: list[str], clip: str, bucket: int, limit: int = 60) -> DataFrame:
    """First sentence of a clip that is no junk, cut at a space."""
    spans = clips.select(*keys, clip, (F.col("s_ms") - 500).alias("__lo"), F.col("e_ms").alias("__hi"))
    hit = points_in_spans(sentences.filter("not junk").select(*keys, "idx", "start_ms", "text"), spans, keys, "start_ms", ("__lo", "__hi"), bucket, "both")
    first = hit.groupBy(*keys, clip).agg(F.min_by(F.trim("text"), F.struct("start_ms", "idx")).alias("t"))
    head = F.substring("t", 1, limit)
    at = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (at >= limit // 2), F.rtrim(F.substring(head, F.lit(1), at))).otherwise(F.rtrim(head))
    return first.select(*keys, clip, F.when(F.length("t") <= limit, F.col("t")).otherwise(cut).alias("title"))
