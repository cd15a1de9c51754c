"""Choosing clips: position, junk, quality and adaptive floors, judges, reply order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgrid.operators.intervals import top_per_key


def with_fallback(df: DataFrame, keys: list[str], good: str) -> DataFrame:
    """Rows whose flag `good` is true; a key with no such row keeps all of its rows."""
    some = df.groupBy(*keys).agg(F.bool_or(good).alias("__some"))
    return df.join(some, keys).filter(F.col(good) | ~F.col("__some")).drop("__some")


def intro_outro(clips: DataFrame, keys: list[str], s: str, e: str, duration: str, head: int = 4,
                tail: int = 3) -> DataFrame:
    """Add why a clip lies wholly in the intro or the outro, and whether it is kept."""
    why = (F.when(F.col(e) * 100 <= F.col(duration) * head, "intro")
           .when(F.col(s) * 100 >= F.col(duration) * (100 - tail), "outro"))
    rows = clips.withColumn("reason", F.when(F.col(duration) > 0, why))
    some = rows.groupBy(*keys).agg(F.bool_or(F.col("reason").isNull()).alias("__some"))
    return (rows.join(some, keys).withColumn("kept", F.col("reason").isNull() | ~F.col("__some")).drop("__some"))


def _best(clips: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """keys, `__n` clips, their highest score `__top` and the whole best row, so that clips of one number are told apart."""
    return clips.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(score).alias("__top"),
                                    F.max_by(F.struct(*clips.columns), F.struct(score, -F.col(tie))).alias("__best"))


def quality_floor(clips: DataFrame, keys: list[str], score: str, tie: str, floor: int = 55) -> DataFrame:
    """Drop clips under the floor; the best one stays when all are under it."""
    stats = _best(clips, keys, score, tie)
    lone = (F.col("__n") < 2) | (F.col("__top") < floor)
    good = clips.join(stats, keys).filter(~lone & (F.col(score) >= floor))
    return good.select(*clips.columns).unionByName(stats.filter(lone).select("__best.*"))


def adaptive_floor(clips: DataFrame, keys: list[str], score: str, tie: str, percent: int = 72,
                   junk: int = 28, parts: int = 0) -> DataFrame:
    """Keep clips near the best of their video; with `parts` set, the best that many above junk."""
    stats = _best(clips, keys, score, tie)
    bar = F.lit(junk * 100) if parts > 0 else F.greatest(F.lit(junk * 100), F.col("__top") * percent)
    rows = clips.join(stats, keys)
    free = rows.filter("__top <= 0")
    good = rows.filter((F.col("__top") > 0) & (F.col(score) * 100 >= bar))
    if parts > 0:
        good = top_per_key(good, keys, [F.col(score).desc(), F.col(tie)], parts, "__rk").drop("__rk")
    # the best one always stays
    best = stats.filter((F.col("__top") > 0) & (F.col("__top") * 100 < bar)).select("__best.*")
    return free.unionByName(good).select(*clips.columns).unionByName(best)


def panel_score(votes: DataFrame, keys: list[str], old: DataFrame | None = None) -> DataFrame:
    """Median to one decimal, vote count and first given reason of each clip's judges.

    With `old` (keys, old_score): one row for each of its clips; one that nobody judged keeps its old score.
    """
    judged = _judged(votes, keys)
    if old is None:
        return judged
    met = old.select(*keys, "old_score").join(judged, keys, "left")
    return met.select(*keys, F.coalesce("score", "old_score").alias("score"), F.coalesce("votes", F.lit(0)).alias("votes"), "reason")


def _judged(votes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.groupBy(*keys).agg(
        F.round(F.expr("percentile(score, 0.5)"), 1).alias("score"), F.count("score").alias("votes"),
        F.min_by("reason", F.when(F.trim("reason") != "", F.col("judge"))).alias("reason"))


def reorder_by_keep(items: DataFrame, reply: DataFrame, keys: list[str], want: int) -> DataFrame:
    """Apply a returned order: valid first occurrences without unusable ones, refilled to `want`.

    `items`: keys, idx; `reply`: keys, pos, idx, usable (false = not worth posting).
    """
    ids = [*keys, "idx"]
    none = F.lit(None).cast(reply.schema["pos"].dataType)
    told = (items.select(*ids, F.lit(True).alias("__item"), none.alias("pos"), F.lit(False).alias("__bad"))
            .unionByName(reply.select(*ids, F.lit(False).alias("__item"), "pos", (~F.col("usable")).alias("__bad"))))
    rows = (told.groupBy(*ids).agg(F.bool_or("__item").alias("__item"), F.min("pos").alias("pos"), F.coalesce(F.bool_or("__bad"), F.lit(False)).alias("__bad"))
            .filter("__item"))
    # where all items are unusable, none is
    named = F.col("pos").isNotNull()
    facts = rows.groupBy(*keys).agg(F.bool_and("__bad").alias("__all"), F.bool_or(named).alias("__any"), F.bool_or(named & ~F.col("__bad")).alias("__clean"))
    rows = (rows.join(facts, keys).withColumn("__bad", F.col("__bad") & ~F.col("__all"))
            .withColumn("__clean", F.when(F.col("__all"), F.col("__any")).otherwise(F.col("__clean"))))
    picked = F.col("pos").isNotNull() & (~F.col("__bad") | ~F.col("__clean"))
    # no valid order: everything stays; otherwise picked, then usable, then unusable in their own order.
    # An unusable item named in the reply never comes back as filler.
    turn = F.when(~F.col("__any"), 0).when(picked, 0).when(~F.col("__bad"), 1).otherwise(2)
    place = F.when(F.col("__any") & picked, F.col("pos")).otherwise(F.col("idx"))
    gone = F.col("__any") & F.col("pos").isNotNull() & ~picked
    ranked = rows.filter(~gone).select(*keys, "idx", turn.alias("turn"), place.alias("place"), "__any")
    kept = top_per_key(ranked.filter("__any"), keys, [F.col("turn"), F.col("place"), F.col("idx")], want)
    whole = ranked.filter("not __any").withColumn("rank", (F.col("idx") + 1).cast("int"))
    return kept.unionByName(whole).select(*keys, "idx", "rank")
