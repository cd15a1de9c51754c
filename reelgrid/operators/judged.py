"""Clip selection from judged candidates, with the reason why each other candidate went."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgrid.operators import intervals as iv, selection as sel, shaping as sh, transcripts as tr
from reelgrid.operators.scan import row_number, scan, time_chunk
from reelgrid.session import checkpointed


def select_judged(cands: DataFrame, votes: DataFrame, sentences: DataFrame, used: DataFrame, videos: DataFrame, keys: list[str], cand: str,
                  limit: int, chunk: int, bucket: int, floor: int = 18_000, default: float = 50.0) -> DataFrame:
    """One row a candidate: keys, cand, s_ms, e_ms (after trimming), score, part (null when it went) and reason (null when it stays).

    The judges' median scores a candidate, `default` where nobody did. Then, each step among what the one before left: junk at the ends is
    trimmed; over 30 % junk words: `junk`; over a quarter shared with a better one: `overlap`; wholly in the first or last minutes: `intro`,
    `outro`; far below the video's best: `score`; mostly shown before: `used`; beyond the best `limit`: `limit`. The place and the used rule
    keep all where they would leave nothing, and the score rule always keeps the best. Parts are numbered along the video.
    `cands`: keys, cand, s_ms, e_ms; `votes`: keys, cand, judge, score, reason; `sentences` as scored; `used`: keys, us, ue; `videos`: keys, duration.
    """
    one = [*keys, cand]
    sentences = checkpointed(sentences.select(*keys, "idx", "start_ms", "end_ms", "n_words", "junk"))      # read twice, and dear to mark
    judged = sel.panel_score(votes, one, cands.select(*one, F.lit(default).alias("old_score"))).select(*one, "score")
    trimmed = sh.trim_junk_edges(cands, sentences, keys, cand, bucket, floor).groupBy(*one).agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"))
    pool = checkpointed(trimmed.join(judged, one).join(videos, keys))
    gone: list[DataFrame] = []

    def keep(left: DataFrame, reason: str) -> DataFrame:
        """Notes what of the pool is not left; what is left, read from a checkpoint, is the next pool."""
        left = checkpointed(left)
        gone.append(pool.join(left.select(*one), one, "left_anti").withColumn("reason", F.lit(reason)))
        return left

    columns = pool.columns
    speech = tr.window_speech(pool, sentences, keys, [cand], "s_ms", "e_ms", bucket).select(*one, "junk_ratio")
    pool = keep(pool.join(speech, one).filter(F.round("junk_ratio", 6) <= 0.30).select(*columns), "junk")
    ranked = pool.withColumn("neg", -F.col("score"))
    pool = keep(iv.greedy_non_overlap(ranked, keys, one, "s_ms", "e_ms", ["neg", cand], (25, 100), chunk, bucket).select(*columns), "overlap")
    placed = checkpointed(sel.intro_outro(pool, keys, "s_ms", "e_ms", "duration"))
    gone.append(placed.filter("not kept").select(*columns, "reason"))
    pool = placed.filter("kept").select(*columns)
    pool = keep(sel.adaptive_floor(pool, keys, "score", cand).select(*columns), "score")
    seen = iv.covered_length(pool, used, keys, [cand], ("s_ms", "e_ms"), ("us", "ue"), chunk, bucket)
    pool = keep(iv.filter_used(seen, keys, "s_ms", "e_ms").select(*columns), "used")
    pool = keep(iv.top_per_key(pool, keys, [F.col("score").desc(), F.col(cand)], limit).select(*columns), "limit")
    parts = scan(pool, keys, ["s_ms", cand], time_chunk("s_ms", chunk), part=row_number()).withColumn("reason", F.lit(None).cast("string"))
    out = parts
    for went in gone:
        out = out.unionByName(went, allowMissingColumns=True)
    return out.select(*one, "s_ms", "e_ms", "score", "part", "reason")
