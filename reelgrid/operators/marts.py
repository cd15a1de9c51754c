"""Activity marts over jobs, clips, channels, the intake ledger and file listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reelgrid.functions.clock import leading_int, local_day, midnight
from reelgrid.operators.scan import running_sum, scan

DAY = 86_400


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def queue_counts(jobs: DataFrame, now: int, tz: str) -> DataFrame:
    since = midnight(now, tz)
    s, kind, today = F.col("status"), F.col("type"), F.col("created_at") >= since
    export = kind == "export"
    return jobs.agg(
        count_if((s == "running") & ~export).alias("analyzing"), count_if((s == "running") & export).alias("exporting"),
        count_if(s == "pending").alias("waiting"), count_if((s == "pending") & ~export).alias("waiting_analyze"),
        count_if((s == "pending") & export).alias("waiting_export"),
        count_if((s == "done") & today).alias("done"), count_if((s == "failed") & today).alias("failed"))


def job_facts(jobs: DataFrame, key: str, now: int) -> DataFrame:
    s, at = F.col("status"), F.coalesce("finished_at", "created_at")
    return jobs.groupBy(key).agg(
        count_if(s == "running").alias("running"), count_if(s == "pending").alias("pending"),
        count_if((s == "failed") & (at >= now - DAY)).alias("failed_24h"),
        count_if((s == "running") & (F.col("type") == "export")).alias("run_export"))


def clip_facts(clips: DataFrame, key: str) -> DataFrame:
    live = clips.filter("status <> 'archived'")
    return live.groupBy(key).agg(F.count("*").alias("clips"), count_if(F.col("status") == "exported").alias("exported"))


def with_facts(base: DataFrame, key: str, *facts: DataFrame) -> DataFrame:
    """Left joins of per-key facts, missing counts as 0."""
    out = reduce(lambda d, f: d.join(f, key, "left"), facts, base)
    return out.na.fill(0, [c for f in facts for c in f.columns if c != key])


def period_stats(ledger: DataFrame, now: int, tz: str) -> DataFrame:
    """Done videos, exported parts and errors of each channel for four periods of local days."""
    today = F.lit(midnight(now, tz))
    start = {"today": today, "yesterday": today - DAY, "7d": today - 6 * DAY, "30d": today - 29 * DAY}
    rows = ledger.filter(F.col("done_at") >= start["30d"])
    cols = []
    for name, low in start.items():
        inside = (F.col("done_at") >= low) & (F.lit(name != "yesterday") | (F.col("done_at") < today))
        done = inside & (F.col("status") == "done")
        cols += [count_if(done).alias(f"done_{name}"),
                 F.sum(F.when(done, leading_int(F.col("note"))).otherwise(0)).alias(f"parts_{name}"),
                 count_if(inside & (F.col("status") == "error")).alias(f"errors_{name}")]
    return rows.groupBy("channel_id").agg(*cols)


def intake_today(ledger: DataFrame, now: int, tz: str) -> DataFrame:
    """Accepted files of the local day and the last intake per channel."""
    low = midnight(now, tz)
    s = F.col("status")
    return ledger.groupBy("channel_id").agg(
        count_if(s.isin("taken", "done", "error") & (F.col("taken_at") >= low)
                 & (F.col("taken_at") < low + DAY)).alias("taken_today"),
        F.max(F.when(s.isin("taken", "done"), F.col("taken_at"))).alias("last_intake"))


def dry_sources(ledger: DataFrame, now: int, tz: str, days: int = 3) -> DataFrame:
    """Channels whose last intake lies `days` or more days back."""
    last = intake_today(ledger, now, tz).filter("last_intake is not null")
    gap = F.datediff(local_day(F.lit(now), tz), local_day(F.col("last_intake"))).cast("long")
    return last.select("channel_id", gap.alias("days")).filter(F.col("days") >= days)


def basic_cut_videos(clips: DataFrame) -> DataFrame:
    """Videos with visible clips none of which was chosen by the model."""
    return (clips.filter("status <> 'archived'").groupBy("channel_id", "video_id")
            .agg(F.count("*").alias("n_clips"), F.coalesce(F.bool_or("llm_used"), F.lit(False)).alias("ai"))
            .filter("not ai").drop("ai"))


def wait_stats(jobs: DataFrame, now: int) -> DataFrame:
    """Waiting time per job type: longest, over ten minutes, median and the sample at 95 %.

    The sample is taken by position in the sorted list, found by counting distinct waits.
    """
    waits = jobs.select("type", (F.coalesce("started_at", F.lit(now)) - F.col("created_at")).alias("wait"))
    base = waits.groupBy("type").agg(F.count("*").alias("n"), F.max("wait").alias("longest"),
                                     count_if(F.col("wait") > 600).alias("over_10min"),
                                     F.expr("percentile(wait, 0.5)").alias("median"))
    counts = waits.groupBy("type", "wait").agg(F.count("*").alias("c"))
    run = scan(counts, ["type"], ["wait"], F.floor(F.col("wait") / 3600), upto=running_sum(F.col("c")))
    rank = F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100))
    at = (run.join(base.select("type", "n"), "type").filter((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank))
          .groupBy("type").agg(F.max("wait").alias("p95")))
    return base.join(at, "type", "left")


def usage_cost(calls: DataFrame, prices: DataFrame, keys: list[Column], rate: int = 26_000) -> DataFrame:
    """Calls, tokens and cost; prices are per million tokens."""
    used = (calls.groupBy(*keys, "model").agg(F.count("*").alias("calls"), F.sum("tok_in").alias("tok_in"),
                                              F.sum("tok_out").alias("tok_out")).join(prices, "model", "left"))
    cost = F.col("tok_in") / 1e6 * F.col("p_in") + F.col("tok_out") / 1e6 * F.col("p_out")
    return used.withColumn("cost", cost).withColumn("cost_local", cost * rate)


def level_gains(levels: DataFrame, over: float = -2.0, ceiling: float = -1.0, background: float = -20.0) -> DataFrame:
    """Gain that brings each asset to its level without passing the peak ceiling."""
    want = F.lit(background) + F.lit(over) + F.col("category_db") - F.col("mean_db")
    db = F.greatest(F.lit(-30.0), F.least(F.lit(15.0), F.least(want, F.lit(ceiling) - F.col("peak_db"))))
    return levels.withColumn("gain_db", db).withColumn("factor", F.pow(F.lit(10.0), db / 20))


def analysis_label(status: DataFrame, steps: int = 5) -> DataFrame:
    """State of the analysis steps of each video, running before failed before complete."""
    s = F.col("status")
    agg = status.groupBy("video_id").agg(F.bool_or(s == "running").alias("r"), F.bool_or(s == "failed").alias("f"),
                                         F.count_distinct(F.when(s.isin("done", "skipped"), F.col("kind"))).alias("ok"))
    return agg.select("video_id", F.when(F.col("r"), "running").when(F.col("f"), "failed")
                      .when(F.col("ok") >= steps, "complete").otherwise("incomplete").alias("label"))


def retention_candidates(analysis: DataFrame, clips: DataFrame, listing: DataFrame, now: int, days: int, key: Sequence[str] = ("video_id",)) -> DataFrame:
    """Transcript bytes of videos whose source is gone and whose clips are old and decided."""
    size = analysis.groupBy(*key, "src").agg(F.sum("bytes").alias("bytes"))
    facts = clips.groupBy(*key).agg(F.max("created_at").alias("newest"),
                                          F.bool_or(F.col("status") == "suggested").alias("open"))
    return (size.join(facts, list(key)).filter((F.col("newest") <= now - days * DAY) & ~F.col("open"))
            .join(listing.select(F.col("path").alias("src")).distinct(), "src", "left_anti").select(*key, "bytes"))


def reanalysis_due(clips: DataFrame, jobs: DataFrame, newest: int = 5, most: int = 2, key: Sequence[str] = ("video_id",)) -> DataFrame:
    """Videos whose newest suggestions were all made without the model and analysed fewer than `most` times."""
    from reelgrid.operators.intervals import top_per_key
    top = top_per_key(clips.filter("status = 'suggested'").select(*key, "clip_id", "llm_used"),
                      list(key), [F.col("clip_id").desc()], newest)
    n = jobs.filter("type <> 'export'").groupBy(*key).agg(F.count("*").alias("runs"))
    return (top.groupBy(*key).agg(F.bool_or("llm_used").alias("ai")).filter("not ai")
            .join(n, list(key), "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
            .filter(F.col("runs") < most).select(*key, "runs"))


def current_job(jobs: DataFrame) -> DataFrame:
    """Newest running job of each video, else its oldest pending one, and the other active jobs."""
    act = jobs.filter(F.col("status").isin("running", "pending"))
    total = act.agg(F.count("*").alias("all_active"))
    own = act.groupBy("video_id").agg(
        F.max(F.when(F.col("status") == "running", F.col("job_id"))).alias("r"),
        F.min(F.when(F.col("status") == "pending", F.col("job_id"))).alias("p"), F.count("*").alias("mine"))
    return own.select("video_id", F.coalesce("r", "p").alias("job_id"),
                      (total.scalar() - F.col("mine")).alias("others"))


def key_health(calls: DataFrame, now: int) -> DataFrame:
    """State of each key from its last call: ready, limited until, or invalid."""
    from reelgrid.functions.errors import error_class, retry_wait_s
    last = (calls.groupBy("key_id").agg(F.max_by(F.struct("at", "ok", "error"), F.struct("at", "call_id")).alias("x"))
            .select("key_id", "x.*").withColumn("cls", error_class(F.col("error"))))
    wait = F.least(F.lit(3600.0), F.coalesce(retry_wait_s(F.col("error")), F.when(F.col("cls") == "day", 3600.0).otherwise(120.0)))
    until = F.when(F.col("cls").isin("day", "minute", "rate"), F.col("at") + F.ceil(wait))
    state = (F.when(F.col("cls").isin("auth", "restricted"), "invalid").when(until > now, "limited").otherwise("ready"))
    return last.select("key_id", state.alias("state"), F.when(state == "limited", until).alias("until"))
