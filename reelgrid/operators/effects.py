"""Effect plans: a few short accents at the seconds that earn them, within a budget of time.

A moment is keys, sec, score, kind. Which effect a moment gets depends on its kind and on what was chosen before, and so does whether it
fits the budget; so of each kind only the best few moments can be chosen: as many as all choices before could block, and one more.
Those few rows a clip are what the greedy choice reads, however long the clip is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelgrid.functions import fixed_values as fv
from reelgrid.operators.folds import unfold_runs
from reelgrid.operators.intervals import top_per_key


def is_flat(rms_range, motion_range):
    """No peak in either series."""
    return (rms_range < fv.FLAT_RANGE) & (motion_range < fv.FLAT_RANGE)


def pick_effects(moments: DataFrame, clips: DataFrame, keys: list[str], level: str = "medium") -> DataFrame:
    """Plan rows keys, start_ms, end_ms, effect, kind. `clips`: keys, seconds, flat, opening.

    Moments are taken by score, earlier ones first on ties, while the level's count and a tenth of the clip are not used up: at least 2.5 s
    from every accent chosen before, each effect once, in flat clips only at joins. With `opening`, an accent at the start comes first.
    """
    most = fv.EFFECTS_BY_LEVEL[level]
    blocked = 1 + 2 * (fv.EFFECT_APART // 1000)                     # whole seconds nearer than the gap to one accent
    long = clips.filter("seconds >= 2")
    fit = moments.join(long, keys).filter(~F.col("flat") | (F.col("kind") == "join"))
    best = top_per_key(fit, [*keys, "kind"], [F.col("score").desc(), F.col("sec")], most * blocked + 1)
    start = (long.filter(F.col("opening") & (F.col("seconds") * 1000 >= fv.OPENING_CLIP))
             .select(*keys, F.lit(0).cast("long").alias("sec"), F.lit(float("-inf")).alias("low"), F.lit("opening").alias("kind"), "seconds"))
    rows = best.select(*keys, "sec", (-F.col("score")).alias("low"), "kind", "seconds").unionByName(start)

    def begin() -> dict:
        return dict(starts=[], used=set(), left=None)

    def step(s: dict, sec: int, kind: str, seconds: int) -> list:
        total = seconds * 1000
        if s["left"] is None:
            s["left"] = total * fv.EFFECT_SHARE / 100
        at = fv.OPENING_AT if kind == "opening" else sec * 1000
        if len(s["starts"]) >= most or s["left"] < fv.EFFECT_SHORTEST or any(abs(sec * 1000 - x) < fv.EFFECT_APART for x in s["starts"]):
            return []
        fresh = [e for e in fv.EFFECTS_BY_KIND[kind] if e not in s["used"]]
        if not fresh:
            return []
        effect = fresh[len(s["starts"]) % len(fresh)]
        if kind == "opening":
            end = at + min(fv.OPENING_LONGEST, max(fv.EFFECT_SHORTEST, fv.EFFECT_MS[effect]))
        else:
            end = min(total - 50, at + max(fv.EFFECT_SHORTEST, min(fv.EFFECT_LONGEST, fv.EFFECT_MS[effect])))
        if end - at < fv.EFFECT_SHORTEST or end - at > s["left"]:
            return []
        s["left"] -= end - at
        s["starts"].append(at)
        s["used"].add(effect)
        return [(at, end, effect, kind)]

    return unfold_runs(rows, keys, ["low", "sec"], ["sec", "kind", "seconds"], "start_ms long, end_ms long, effect string, kind string",
                       begin, step, lambda s: [])


def effect_coverage(plan: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Accents, their time and its percentage of the clip; clips without accents have zeros. `clips`: keys, seconds."""
    used = plan.groupBy(*keys).agg(F.count("*").alias("n_effects"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("effect_ms"))
    told = clips.select(*keys, "seconds").join(used, keys, "left")
    ms = F.coalesce("effect_ms", F.lit(0))
    share = F.when(F.col("seconds") > 0, F.round(ms / (F.col("seconds") * 10), 4)).otherwise(0.0)
    return told.select(*keys, F.coalesce("n_effects", F.lit(0)).alias("n_effects"), ms.alias("effect_ms"), share.alias("percent"))
