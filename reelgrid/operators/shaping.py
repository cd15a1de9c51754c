"""Building clips: candidate windows, spread choice, junk edges and length rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from reelgrid.operators.folds import fold_runs
from reelgrid.operators.intervals import min_spacing
from reelgrid.operators.joins import nearest_edges, overlap_join, points_in_spans
from reelgrid.operators.scan import next_value, running_max, running_sum, scan, time_chunk
from reelgrid.session import checkpointed


def target_length(video: Column, idx: Column, low: int, high: int) -> Column:
    """A stable length in [low, high] for each anchor, leaning to the middle (mean of two draws)."""
    h = F.md5(F.concat_ws(":", video.cast("string"), idx.cast("string")))
    def draw(at: int) -> Column:
        return F.conv(F.substring(h, at, 8), 16, 10).cast("long") % (high - low + 1)
    return F.lit(low) + F.floor((draw(1) + draw(9)) / 2)


def candidate_windows(sentences: DataFrame, cuts: DataFrame, keys: list[str], low: int, high: int,
                      chunk: int, bucket: int) -> DataFrame:
    """A window per anchor sentence, grown sentence by sentence to its target length and closed at a
    sentence end, near a cut, or when too long. `sentences`: keys, idx, start_ms, end_ms, closes.

    Each anchor meets only sentences that begin before its longest end, so the pairs are bounded by
    the speech inside one window length.
    """
    near = nearest_edges(sentences, cuts, keys, "end_ms", "cut_ms", chunk)
    near = near.withColumn("soft", F.col("closes") | F.coalesce(F.abs(F.col("nearest") - F.col("end_ms")) < 600, F.lit(False)))
    rows = scan(near, keys, ["start_ms", "idx"], time_chunk("start_ms", chunk), prev=running_max(F.col("end_ms"), False))
    later = rows.select(*keys, F.coalesce("prev", F.col("start_ms")).alias("rs"), F.col("end_ms").alias("re"), "soft")
    anchors = sentences.select(*keys, F.col("idx").alias("anchor"), F.col("start_ms").alias("a"),
                               (F.col("start_ms") + high).alias("a_end"),
                               target_length(F.col(keys[0]), F.col("idx"), low, high).alias("target"))
    pairs = overlap_join(anchors, later, keys, ("a", "a_end"), ("rs", "re"), bucket)
    length = F.col("re") - F.col("a")
    stop = ((length >= F.col("target")) & (F.col("soft") | (length >= F.col("target") + 8000))) | (length >= high)
    ends = pairs.groupBy(*keys, "anchor", "a").agg(F.min(F.when(stop, F.col("re"))).alias("stop"), F.max("re").alias("far"))
    last = sentences.groupBy(*keys).agg(F.max("end_ms").alias("last_end"))
    end = F.coalesce("stop", "far")
    shown = F.least(end, F.col("a") + high)
    size = shown - F.col("a")
    return (ends.join(last, keys).filter((size >= low - 500) | ((shown >= F.col("last_end") - 500) & (size * 2 >= low)))
            .select(*keys, "anchor", F.col("a").alias("s_ms"), shown.alias("e_ms")))


def spread_pick(cands: DataFrame, keys: list[str], cand: str, s: str, e: str, rank: str, duration: str,
                limit: int, gap: Column) -> DataFrame:
    """At most `limit` candidates per key, one per equal part of the duration by rank, at least `gap`
    apart; refilled by rank with the gap, then without it. `rank` is unique, 0 the best.

    Candidates no longer overlap much here, so a key has at most duration / length of them.
    """
    mid = F.floor((F.col(s) + F.col(e)) / 2)
    rows = (cands.select(*keys, cand, s, rank, gap.alias("__gap"), F.floor(mid * limit / F.col(duration)).alias("__part")))

    def by_part(state: dict, part: int, x: int, g: int) -> bool:
        if part >= limit or part in state["parts"] or any(abs(x - k) < g for k in state["kept"]):
            return False
        state["parts"].add(part)
        state["kept"].append(x)
        return True

    def fresh() -> dict:
        return {"parts": set(), "kept": None}

    first = fold_runs(checkpointed(rows), keys, ["__part", rank], ["__part", s, "__gap"], lambda: {"parts": set(), "kept": []},
                      by_part, "__p1", T.BooleanType())

    def refill(df: DataFrame, done: str, name: str, spaced: bool) -> DataFrame:
        have = df.groupBy(*keys).agg(F.collect_list(F.when(F.col(done), F.col(s))).alias("__have"))   # at most `limit`
        def step(state: dict, taken: bool, x: int, g: int, already) -> bool:
            if state["kept"] is None:
                state["kept"] = list(already)
            if taken:
                return True
            if len(state["kept"]) >= limit or (spaced and any(abs(x - k) < g for k in state["kept"])):
                return False
            state["kept"].append(x)
            return True
        return fold_runs(df.join(have, keys), keys, [rank], [done, s, "__gap", "__have"], fresh, step, name,
                         T.BooleanType()).drop("__have")

    second = checkpointed(refill(checkpointed(first), "__p1", "__p2", True))
    out = refill(second, "__p2", "__p3", False)
    return cands.join(out.filter("__p3").select(*keys, cand), [*keys, cand], "left_semi")


def _pared(clips: DataFrame, heard: DataFrame, group: list[str], floor: int, most: int, back: bool) -> DataFrame:
    """`ranges` of each clip without junk at one end: the longest run of junk sentences there whose loss leaves `floor`.

    Sentences are taken from the end inwards, each from the pieces that it meets. How far the ones before a sentence reach tells what the
    clip is by then, so whether the sentence is still in it, touches its outermost piece and leaves enough are columns; the first that stops
    ends the run.
    """
    edges = [F.desc("start_ms"), F.desc("idx")] if back else [F.asc("start_ms"), F.asc("idx")]
    order = W.partitionBy(*group).orderBy(*edges)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    reach = F.min("start_ms") if back else F.max("end_ms")

    def cut(ranges: Column, at: Column) -> Column:
        side = ((lambda r: F.struct(r["s_ms"].alias("s_ms"), F.least(r["e_ms"], at).alias("e_ms"))) if back
                else (lambda r: F.struct(F.greatest(r["s_ms"], at).alias("s_ms"), r["e_ms"].alias("e_ms"))))
        return F.filter(F.transform(ranges, side), lambda r: r["e_ms"] - r["s_ms"] >= 1000)

    s, e = F.col("start_ms"), F.col("end_ms")

    def met(r: Column) -> Column:
        return (e > r["s_ms"]) & (s < r["e_ms"])

    # one row for each piece that a sentence meets: a sentence over the gap of two pieces is taken from each, as a step of its own
    rows = (heard.join(clips, group).filter(F.exists("ranges", met)).withColumn("__reach", reach.over(before))
            .select("*", F.posexplode("ranges").alias("__at", "__piece")).filter(met(F.col("__piece")))
            .withColumn("__nth", -F.col("__at") if back else F.col("__at")))
    passed = (lambda r, i: (i > F.col("__at")) & (e > r["s_ms"])) if back else (lambda r, i: (i < F.col("__at")) & (s < r["e_ms"]))
    now = F.when(F.col("__reach").isNull(), F.col("ranges")).otherwise(cut(F.col("ranges"), F.col("__reach")))
    # of the pieces before its own, those that the sentence meets have lost all to it by then
    rows = (rows.withColumn("__cur", now).withColumn("__gone", F.filter("ranges", passed))
            .withColumn("__cur", F.filter("__cur", lambda r: ~F.exists("__gone", lambda g: (r["e_ms"] > g["s_ms"]) & (r["s_ms"] < g["e_ms"]))))
            .withColumn("__end", F.try_element_at("__cur", F.lit(-1 if back else 1))))
    own = F.exists("__cur", lambda r: met(r) & (r["e_ms"] > F.col("__piece.s_ms")) & (r["s_ms"] < F.col("__piece.e_ms")))
    touches = (s < F.col("__end.e_ms") - 10) & (e > F.col("__end.s_ms") + 10)
    beyond = e <= F.col("__end.s_ms") if back else s >= F.col("__end.e_ms")
    stop = F.coalesce(F.when(own, ~(F.col("junk") & touches)).otherwise(beyond), F.lit(True))
    rim = cut(F.array("__end"), s if back else e)
    rest = F.slice("__cur", 1 if back else 2, F.greatest(F.size("__cur") - 1, F.lit(0)))
    steps = W.partitionBy(*group).orderBy(*edges, F.asc("__nth")).rowsBetween(W.unboundedPreceding, 0)
    told = (rows.withColumn("__in", own.cast("int")).withColumn("__stop", stop.cast("int"))
            .withColumn("__new", F.filter(F.concat(rest, rim) if back else F.concat(rim, rest), lambda r: r["e_ms"] - r["s_ms"] >= 1000))
            .withColumn("__n", F.sum("__in").over(steps)).withColumn("__off", F.max("__stop").over(steps)))
    left = F.aggregate("__new", F.lit(0).cast("long"), lambda t, r: t + r["e_ms"] - r["s_ms"])
    ok = (F.col("__in") == 1) & (F.col("__off") == 0) & (F.col("__n") <= most) & (left >= floor)
    ends = told.filter(ok).groupBy(*group).agg(F.max_by("__new", "__n").alias("__new"))
    return clips.join(ends, group, "left").select(*group, F.coalesce("__new", "ranges").alias("ranges"))


def trim_junk_edges(segs: DataFrame, sentences: DataFrame, keys: list[str], clip: str, bucket: int,
                    floor: int = 15_000, most: int = 3) -> DataFrame:
    """Move clip ends past up to `most` junk sentences on each side while `floor` stays; pieces left under a second go.

    A clip's sentences are the rows of one window; a clip is as long as its pieces are.
    """
    group = [*keys, clip]
    heard = (overlap_join(segs.select(*group, "s_ms", "e_ms"), sentences.select(*keys, "idx", "start_ms", "end_ms", "junk"),
                          keys, ("s_ms", "e_ms"), ("start_ms", "end_ms"), bucket)
             .select(*group, "idx", "start_ms", "end_ms", "junk").distinct())
    clips = segs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("s_ms", "e_ms"))).alias("ranges"))
    pared = _pared(_pared(clips, heard, group, floor, most, False), heard, group, floor, most, True)
    return (pared.select(*group, F.posexplode("ranges").alias("seg_idx", "r")).select(*group, "seg_idx", "r.s_ms", "r.e_ms"))


def enforce_length(clips: DataFrame, edges: DataFrame, keys: list[str], clip: str, low: int, duration: str,
                   bucket: int) -> DataFrame:
    """Stretch clips under `low`: the end forward, then the start back, closing on an edge within 2 s.

    `clips`: keys, clip, first_s, last_e, total, duration. Cut longer clips with `keep_total` before.
    """
    short = F.col("total") < low - 2000
    add = F.when(short, F.least(F.greatest(F.lit(0), F.col(duration) - F.col("last_e")), low - F.col("total"))).otherwise(0)
    rows = clips.withColumn("__add", F.when(add > 10, add).otherwise(0)).withColumn("__t", F.col("last_e") + F.col("__add"))
    marks = edges.select(*keys, F.col("edge_ms"))

    def found(df: DataFrame, low_ms: int, high_ms: int, pick, name: str) -> DataFrame:
        spans = df.select(*keys, clip, (F.col("__t") - low_ms).alias("__lo"), (F.col("__t") + high_ms).alias("__hi"))
        hit = (points_in_spans(marks, spans, keys, "edge_ms", ("__lo", "__hi"), bucket, "both")
               .groupBy(*keys, clip).agg(pick("edge_ms").alias(name)))
        return df.join(hit, [*keys, clip], "left")

    up = found(rows, 50, 2000, F.max, "__up")
    end = F.least(F.coalesce("__up", "__t"), F.col(duration))
    end = F.when(end - F.col("last_e") < F.col("__add") - 500, F.least(F.col("__t"), F.col(duration))).otherwise(end)
    up = (up.withColumn("__e", F.when(F.col("__add") > 0, end).otherwise(F.col("last_e")))
          .withColumn("total", F.col("total") + F.col("__e") - F.col("last_e")).withColumn("last_e", F.col("__e")))
    need = F.when(short & (low - F.col("total") > 500), F.least(F.greatest(F.lit(0), F.col("first_s")), low - F.col("total"))).otherwise(0)
    down = up.drop("__t", "__e", "__up").withColumn("__need", F.when(need > 10, need).otherwise(0)).withColumn("__t", F.col("first_s") - F.col("__need"))
    down = found(down, 2000, 50, F.min, "__down")
    start = F.greatest(F.lit(0), F.coalesce("__down", "__t"))
    start = F.when(F.col("first_s") - start < F.col("__need") - 500, F.greatest(F.lit(0), F.col("__t"))).otherwise(start)
    down = (down.withColumn("__s", F.when(F.col("__need") > 0, start).otherwise(F.col("first_s")))
            .withColumn("total", F.col("total") + F.col("first_s") - F.col("__s")).withColumn("first_s", F.col("__s")))
    return down.select(*keys, clip, "first_s", "last_e", "total", (F.col("total") < low - 2000).alias("too_short"))


def _look_ahead(clips: DataFrame, sentences: DataFrame, keys: list[str], clip: str, target: int, bucket: int,
                gap: int, hard_gap: int) -> DataFrame:
    """keys, clip, last_e, total, __from, __to: where the sentences end that an extension can need.

    It cannot pass a pause over `hard_gap`, nor the sentence at which even the least that it can have gained (a sum
    over all sentences, less the 50 ms by which ends may fall behind at each pause) fills the target.
    """
    heard = scan(sentences.select(*keys, "idx", "start_ms", "end_ms"), keys, ["start_ms", "idx"], time_chunk("start_ms", bucket),
                 last=running_max(F.col("end_ms"), False))
    pause = F.col("start_ms") - F.col("last")
    gain = F.greatest(F.lit(0), F.when(pause <= gap - 50, F.col("end_ms") - F.col("last")).otherwise(F.col("end_ms") - F.col("start_ms") - 50))
    said = heard.select(*keys, F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.col("idx").cast("long").alias("id"),
                        gain.cast("long").alias("gain"), F.when(pause > hard_gap, F.col("start_ms")).alias("stop"), F.col("start_ms").alias("start"),
                        F.lit(None).cast("long").alias("last_e"), F.lit(None).cast("long").alias("total"))
    asked = clips.select(*keys, F.col("last_e").alias("at"), F.lit(1).alias("kind"), F.col(clip).cast("long").alias("id"),
                         F.col("last_e").cast("long").alias("last_e"), F.col("total").cast("long").alias("total"))
    summed = scan(said.unionByName(asked, allowMissingColumns=True), keys, ["at", "kind", "id"], time_chunk("at", bucket),
                  sum=running_sum(F.coalesce("gain", F.lit(0).cast("long"))), wall=next_value(F.col("stop")))
    # the second order is that of the sums: a clip stands before the sentence that fills its target for certain
    full = F.col("sum") + target - F.col("total") + gap + 100
    by_sum = summed.withColumns({"side": 1 - F.col("kind"), "level": F.when(F.col("kind") == 1, full).otherwise(F.col("sum")),
                                 "place": F.coalesce("start", F.lit(-1))})
    met = scan(by_sum, keys, ["level", "side", "place", "id"], time_chunk("level", bucket), full=next_value(F.col("start"))).filter("kind = 1")
    wall = F.when(F.col("wall") - F.col("last_e") > hard_gap, F.col("wall"))
    ends = sentences.groupBy(*keys).agg(F.max("start_ms").alias("__end"))
    to = F.least(wall, F.col("full"), F.col("__end"))
    return met.join(ends, keys).select(*keys, F.col("id").alias(clip), "last_e", "total", F.col("last_e").alias("__from"),
                                       (F.greatest(to, F.col("last_e")) + 1).alias("__to"))


def extend_to_target(clips: DataFrame, sentences: DataFrame, keys: list[str], clip: str, target: int, most: int,
                     bucket: int, gap: int = 6000, hard_gap: int = 8000) -> DataFrame:
    """Sentences appended to a clip until its target: rows (clip, start, end) of what is added.

    Stops at the target, the length limit, a long pause or a junk sentence. A pause up to `gap` is
    included, a longer one starts a new segment.
    """
    open_ = clips.filter(F.col("total") < target)
    look = _look_ahead(open_, sentences, keys, clip, target, bucket, gap, hard_gap)
    nxt = overlap_join(look, sentences.select(*keys, "idx", "start_ms", "end_ms", "junk"), keys, ("__from", "__to"),
                       ("start_ms", "end_ms"), bucket).filter(F.col("end_ms") > F.col("last_e") + 50)

    # A sentence counts if it ends over 50 ms after the last one that counted. Only sentences that end after all before them can, and
    # those are kept apart by a greedy walk; what the clip holds before each of them are then sums over earlier rows.
    one = [*keys, clip]
    order = W.partitionBy(*one).orderBy("start_ms", "idx")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    nxt = checkpointed(nxt.select(*one, "idx", "start_ms", "end_ms", "junk", "last_e", "total"))
    later = nxt.withColumn("__far", F.max("end_ms").over(before)).filter("__far is null or end_ms > __far").select(*one, "idx", "end_ms")
    start = open_.select(*one, F.lit(-1).cast("long").alias("idx"), F.col("last_e").alias("end_ms"))
    counted = min_spacing(later.unionByName(start), one, "end_ms", ["idx"], 51, bucket).select(*one, "idx").withColumn("__new", F.lit(True))
    rows = nxt.join(counted, [*one, "idx"], "left").withColumn("__new", F.coalesce("__new", F.lit(False)))
    front = F.greatest(F.col("last_e"), F.max(F.when(F.col("__new"), F.col("end_ms"))).over(before))
    pause = F.col("start_ms") - F.col("__front")
    size = F.when(F.col("__new"), F.col("end_ms") - F.col("piece_s")).otherwise(0)
    seen = (rows.withColumn("__front", front).withColumn("piece_s", F.when(pause <= gap, F.col("__front")).otherwise(F.col("start_ms")))
            .withColumn("__sum", F.col("total") + F.sum(size).over(upto)))
    over = (F.col("__sum") > most + 500) if most else F.lit(False)
    full = F.col("__sum") - size >= target
    stop = (F.col("__new") & ((pause > hard_gap) | F.col("junk") | over | full)).cast("int")
    added = seen.withColumn("__stop", F.max(stop).over(upto)).filter("__new and __stop = 0")
    return added.select(*one, "piece_s", F.col("end_ms").alias("piece_e"))
