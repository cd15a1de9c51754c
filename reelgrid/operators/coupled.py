"""Chains of yes-or-no moves where each answer hangs on the answer before, decided without walking the chain.

A mark may stay or move, and whether it may move hangs on where the mark before it ended up: two places. So a mark has the same answer for
both, or it passes the answer before it on, as it is or turned around. The answer is that of the last mark with one answer, turned
as often as the marks since then turn it: running values of a window, no loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from reelgrid.operators.joins import off_word, snap, snap_to_scene


def coupled_moves(marks: DataFrame, keys: list[str], order: str, stay: str, move: str, allowed: Callable[[Column], Column],
                  first: Column, name: str) -> DataFrame:
    """Add `name`: `move` where allowed(place of the mark before, or `first`) holds, else `stay`. A key's marks are few: cuts or parts of a clip."""
    chain = W.partitionBy(*keys).orderBy(order)

    def answer(before: str) -> Column:
        return F.coalesce(allowed(F.coalesce(F.lag(before).over(chain), first)), F.lit(False)).cast("int")

    told = marks.withColumn("__s", answer(stay)).withColumn("__m", answer(move))
    turns = F.sum(F.when((F.col("__s") == 1) & (F.col("__m") == 0), 1).otherwise(0)).over(chain)
    turned = told.withColumn("__t", turns)
    sure = F.when(F.col("__s") == F.col("__m"), F.struct(F.col("__s").alias("a"), F.col("__t").alias("t")))
    known = turned.withColumn("__k", F.last(sure, True).over(chain))
    moved = (F.col("__k.a") + F.col("__t") - F.col("__k.t")) % 2 == 1
    return known.withColumn(name, F.when(moved, F.col(move)).otherwise(F.col(stay))).drop("__s", "__m", "__t", "__k")


def snap_parts(parts: DataFrame, edges: DataFrame, cuts: DataFrame, sentences: DataFrame, words: DataFrame, keys: list[str], chunk: int, bucket: int,
               tolerance: int = 1500, shortest: int = 1500) -> DataFrame:
    """Part ends moved to natural places: keys, idx, start_ms, end_ms, mode. Parts of a key follow each other without holes.

    Where the voice changes, and at both ends of the script, a scene cut that parts no sentence wins over a sentence edge; elsewhere the sentence edge; a
    place inside a word goes to its nearer end. An end that two parts share moves both, unless either would be under `shortest`.
    """
    chain = W.partitionBy(*keys).orderBy("idx")
    rows = parts.select(*keys, "idx", "start_ms", "end_ms", "mode", F.lead("mode").over(chain).alias("next_mode"), F.lag("idx").over(chain).alias("prev"),
                        F.lead("end_ms").over(chain).alias("next_end"))
    # one mark for the end of each part, and one (0) for the start of the first
    ends = rows.select(*keys, "idx", F.col("end_ms").alias("t"), F.coalesce(F.col("next_mode") != F.col("mode"), F.lit(True)).alias("edge"))
    start = rows.filter("prev is null").select(*keys, F.lit(-1).cast("long").alias("idx"), F.col("start_ms").alias("t"), F.lit(True).alias("edge"))
    marks = ends.unionByName(start)
    plain = snap(marks.filter("not edge"), edges, keys, "t", "edge_ms", tolerance, chunk, "snapped")
    scenic = snap_to_scene(marks.filter("edge"), edges, cuts, sentences, keys, "t", chunk, tolerance)
    both = plain.select(*keys, "idx", "t", "snapped").unionByName(scenic.select(*keys, "idx", "t", "snapped"))
    placed = off_word(both, words, keys, ["idx"], "snapped", bucket).select(*keys, "idx", F.col("whole_word_ms").alias("move"))
    first = placed.filter("idx = -1").select(*keys, F.col("move").alias("first_move"))
    told = rows.join(placed.filter("idx >= 0"), [*keys, "idx"]).join(first, keys)
    whole = W.partitionBy(*keys)
    opening = F.min_by("start_ms", "idx").over(whole)
    first_end = F.min_by("end_ms", "idx").over(whole)
    far = F.abs(F.col("first_move") - opening) >= 10
    told = told.withColumn("opening", F.when(far & (first_end - F.col("first_move") >= shortest), F.col("first_move")).otherwise(opening))
    # the end of the script moves before the inner ends do
    last_start = F.when(F.col("prev").isNull(), F.col("opening")).otherwise(F.col("start_ms"))
    last = F.when((F.abs(F.col("move") - F.col("end_ms")) >= 10) & (F.col("move") - last_start >= shortest), F.col("move")).otherwise(F.col("end_ms"))
    told = told.withColumn("closing", F.when(F.col("next_end").isNull(), last))
    told = told.withColumn("next_end", F.coalesce(F.lead("closing").over(chain), F.col("next_end")))

    def allowed(before: Column) -> Column:
        return ((F.abs(F.col("move") - F.col("end_ms")) >= 10) & (F.col("move") - before >= shortest)
                & (F.col("next_end") - F.col("move") >= shortest))

    moved = coupled_moves(told, keys, "idx", "end_ms", "move", allowed, F.col("opening"), "to")
    moved = moved.withColumn("to", F.coalesce("closing", "to"))
    return moved.select(*keys, "idx", F.coalesce(F.lag("to").over(chain), F.col("opening")).alias("start_ms"), F.col("to").alias("end_ms"), "mode")
