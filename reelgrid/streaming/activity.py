"""Live counters and progress: status transitions, daily counts, throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity_counters(transitions: DataFrame) -> DataFrame:
    """Jobs per channel and status from (channel_id, old_status, new_status) events; update mode.

    Each event is -1 for the status left and +1 for the one entered, so sums combine map-side.
    """
    moves = F.filter(F.array(F.struct(F.col("old_status").alias("status"), F.lit(-1).alias("d")),
                             F.struct(F.col("new_status").alias("status"), F.lit(1).alias("d"))), lambda m: m.status.isNotNull())
    return (transitions.select("channel_id", F.explode(moves).alias("m"))
            .groupBy("channel_id", F.col("m.status").alias("status")).agg(F.sum("m.d").alias("jobs")))


def daily_counts(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Finished and failed jobs per day; events later than the watermark are dropped."""
    return (events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"))
            .agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
            .select(F.col("w.start").cast("date").alias("day"), "done", "failed"))


def throttle(state: dict, at_ms: int, step: str, fraction: float, every_ms: int = 300) -> bool:
    """Keep a progress event that is first, last, a new step, or `every_ms` after the last kept one."""
    keep = not state or fraction >= 1.0 or step != state["step"] or at_ms - state["at"] >= every_ms
    if keep:
        state.update(at=at_ms, step=step)
    return keep


def throttled_progress(events: DataFrame, every_ms: int = 300) -> DataFrame:
    """Streaming form of `throttle` per job: (job_id, at_ms, step, fraction) kept events."""
    out = "job_id long, at_ms long, step string, fraction double"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("at", "step"), state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["at_ms", "fraction"])
        keep = [throttle(held, a, s, f, every_ms) for a, s, f in zip(rows.at_ms, rows.step, rows.fraction)]
        state.update((int(held["at"]), str(held["step"])))
        yield rows.loc[keep, ["job_id", "at_ms", "step", "fraction"]]

    return (events.groupBy("job_id").applyInPandasWithState(
        go, out, "at long, step string", "append", GroupStateTimeout.NoTimeout))
