"""Range joins, nearest-edge lookup and the joins built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelgrid.operators.scan import last_value, next_value, scan, time_chunk


_BEFORE_ALL = -(1 << 62)            # earlier than any time


def _touched(start: Column, end: Column, width: int) -> Column:
    low, high = F.floor(start / F.lit(width)), F.floor(end / F.lit(width))
    return F.sequence(low, F.greatest(low, high))


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.explode(_touched(start, end, width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 bucket: int, touch: bool = False, how: str = "inner") -> DataFrame:
    """Pairs of one key whose spans overlap (strictly; `touch` also takes equal ends).

    Both sides are spread over timeline buckets and joined on (key, bucket), so a hot key is
    many join groups; a pair is kept only in its first common bucket, which makes it unique.
    Non-key column names must differ between the sides.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    a = left.withColumn("__b", _buckets(ls, le, bucket))
    b = right.withColumn("__b", _buckets(rs, re, bucket))
    first = F.floor(F.greatest(ls, rs) / F.lit(bucket))
    meets = (le >= rs) & (ls <= re) if touch else (le > rs) & (ls < re)
    pairs = a.join(b, [*keys, "__b"]).filter(meets & (F.col("__b") == first)).drop("__b")
    if how == "inner":
        return pairs
    return pairs.unionByName(
        left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti"),
        allowMissingColumns=True)


def shared_with(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str],
                right_span: tuple[str, str], bucket: int, name: str) -> DataFrame:
    """Rows of `left` with `name`, the time shared with one span of `right`.

    A pair is there once, as in `overlap_join`; rows of time 0 come along, so that each row of
    `left` is there at least once, also with nulls in its key or span.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re = (F.col(c) for c in right_span)
    a = left.withColumn("__b", F.explode_outer(_touched(ls, le, bucket)))
    b = right.withColumn("__b", _buckets(rs, re, bucket))
    meets = (le > rs) & (ls < re) & (F.col("__b") == F.floor(F.greatest(ls, rs) / F.lit(bucket)))
    shared = F.when(meets, F.least(le, re) - F.greatest(ls, rs)).otherwise(F.lit(0).cast("long"))
    return a.join(b, [*keys, "__b"], "left").select(*left.columns, shared.alias(name))


def points_in_spans(points: DataFrame, spans: DataFrame, keys: list[str], t: str,
                    span: tuple[str, str], bucket: int, closed: str = "left",
                    pad: int = 0) -> DataFrame:
    """(point, span) pairs; `closed` is left (s<=t<e), both (s<=t<=e) or neither (s<t<e)."""
    s, e, x = F.col(span[0]) - F.lit(pad), F.col(span[1]) + F.lit(pad), F.col(t)
    inside = {"left": (s <= x) & (x < e), "both": (s <= x) & (x <= e),
              "neither": (s < x) & (x < e)}[closed]
    a = points.withColumn("__b", F.floor(x / F.lit(bucket)))
    b = spans.withColumn("__b", _buckets(s, e, bucket))
    return a.join(b, [*keys, "__b"]).filter(inside).drop("__b")


def nearest_edges(points: DataFrame, edges: DataFrame, keys: list[str], t: str, edge: str,
                  chunk: int) -> DataFrame:
    """Add `nearest` to each point: the closest edge of its key, the smaller one on ties.

    Points and distinct edges are merged into one ordered stream, and the last edge before is carried along it. Each edge brings the
    one after it along, and a mark before all times the first one of its key, so that the stream is sorted one way only. Linear, no pairs.
    """
    marks = edges.select(*keys, F.col(edge).alias("__t")).distinct()
    known = scan(marks, keys, ["__t"], time_chunk("__t", chunk), __next=next_value(F.col("__t")))
    ahead = marks.groupBy(*keys).agg(F.min("__t").alias("__next")).withColumn("__t", F.lit(_BEFORE_ALL))
    stream = (points.withColumnRenamed(t, "__t").withColumn("__kind", F.lit(1))
              .unionByName(known.unionByName(ahead).withColumn("__kind", F.lit(0)), allowMissingColumns=True))
    tie = [c for c in points.columns if c not in keys and c != t]
    mark = F.when(F.col("__kind") == 0, F.struct(F.when(F.col("__t") > _BEFORE_ALL, F.col("__t")).alias("low"), F.col("__next").alias("high")))
    seen = scan(stream.withColumn("__mark", mark).drop("__next"), keys, ["__t", "__kind", *tie], time_chunk("__t", chunk), __near=last_value(F.col("__mark")))
    low, high, x = F.col("__near.low"), F.col("__near.high"), F.col("__t")
    pick = (F.when(low.isNull(), high).when(high.isNull(), low)
            .when(x - low <= high - x, low).otherwise(high))
    return seen.filter("__kind = 1").withColumn("nearest", pick).withColumnRenamed("__t", t).select(*points.columns, "nearest")


def edge_within(df: DataFrame, edges: DataFrame, keys: list[str], ids: list[str], edge: str, low: Column, high: Column,
                bucket: int, name: str, last: bool) -> DataFrame:
    """Add the last (or first) edge of the key inside [low, high], spans of bounded length; null where there is none."""
    spans = df.select(*keys, *ids, low.alias("__lo"), high.alias("__hi"))
    hit = points_in_spans(edges.select(*keys, F.col(edge).alias("__t")), spans, keys, "__t", ("__lo", "__hi"), bucket, "both")
    found = hit.groupBy(*keys, *ids).agg((F.max if last else F.min)("__t").alias(name))
    return df.join(found, [*keys, *ids], "left")


def snap(points: DataFrame, edges: DataFrame, keys: list[str], t: str, edge: str,
         tolerance: int, chunk: int, name: str = "snapped") -> DataFrame:
    """Each time moves to its nearest edge if that is within the tolerance."""
    found = nearest_edges(points, edges, keys, t, edge, chunk)
    near = F.abs(F.col("nearest") - F.col(t)) <= F.lit(tolerance)
    return found.withColumn(name, F.when(near, F.col("nearest")).otherwise(F.col(t))).drop("nearest")


def snap_to_scene(points: DataFrame, edges: DataFrame, cuts: DataFrame, sentences: DataFrame,
                  keys: list[str], t: str, chunk: int, tolerance: int = 1500,
                  scene_tolerance: int = 2000, margin: int = 150) -> DataFrame:
    """The nearest scene cut within reach wins unless it falls inside a sentence."""
    base = snap(points, edges, keys, t, "edge_ms", tolerance, chunk, "by_edge")
    near = nearest_edges(base, cuts, keys, t, "cut_ms", chunk)
    near = near.withColumn("cut", F.when(F.abs(F.col("nearest") - F.col(t)) <= scene_tolerance,
                                         F.col("nearest"))).drop("nearest")
    inner = sentences.select(*keys, (F.col("start_ms") + margin).alias("__s"),
                             (F.col("end_ms") - margin).alias("__e")).filter("__e > __s")
    cut_times = near.filter("cut is not null").select(*keys, "cut").distinct()
    spoiled = points_in_spans(cut_times, inner, keys, "cut", ("__s", "__e"), max(1, chunk // 10),
                              "neither").select(*keys, "cut").distinct().withColumn("bad", F.lit(True))
    return (near.join(spoiled, [*keys, "cut"], "left")
            .withColumn("snapped", F.when(F.col("cut").isNotNull() & F.col("bad").isNull(), F.col("cut"))
                        .otherwise(F.col("by_edge"))).drop("cut", "bad", "by_edge"))


def off_word(points: DataFrame, words: DataFrame, keys: list[str], point_id: list[str], t: str,
             bucket: int, margin: int = 10) -> DataFrame:
    """A time inside a word moves to the nearer word edge (the start on ties)."""
    inner = words.select(*keys, F.col("start_ms").alias("__ws"), F.col("end_ms").alias("__we"),
                         (F.col("start_ms") + margin).alias("__s"),
                         (F.col("end_ms") - margin).alias("__e")).filter("__e > __s")
    hit = (points_in_spans(points.select(*keys, *point_id, t), inner, keys, t, ("__s", "__e"),
                           bucket, "neither")
           .withColumn("__to", F.when(F.col(t) - F.col("__ws") <= F.col("__we") - F.col(t),
                                      F.col("__ws")).otherwise(F.col("__we")))
           .groupBy(*keys, *point_id).agg(F.min_by("__to", F.struct("__ws", "__we")).alias("__to")))
    return (points.join(hit, [*keys, *point_id], "left")
            .withColumn("whole_word_ms", F.coalesce(F.col("__to"), F.col(t))).drop("__to"))
