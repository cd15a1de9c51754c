"""Table rewrites and joins on the intake ledger, jobs and listings: old table + changes -> new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelgrid.functions.fixed_values import CLAIM_EXPIRED
from reelgrid.operators.scan import running_sum, scan


def seen_before(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listing rows with the newest taken / done entry of the same channel and hash, if any."""
    past = (ledger.filter(F.col("status").isin("taken", "done")).groupBy("channel_id", "file_hash")
            .agg(F.max_by(F.struct("file_name", "taken_at", "ledger_id"), "ledger_id").alias("m"))
            .select("channel_id", "file_hash", F.col("m.file_name").alias("old_name"),
                    F.col("m.taken_at").alias("old_at"), F.col("m.ledger_id").alias("old_id")))
    return listing.join(past, ["channel_id", "file_hash"], "left")


def stranded_videos(ledger: DataFrame, clips: DataFrame, jobs: DataFrame) -> DataFrame:
    """Taken videos with suggestions, no active job and no canceled or skipped export."""
    active = jobs.filter(F.col("status").isin("pending", "running"))
    stopped = jobs.filter((F.col("type") == "export") & F.col("status").isin("canceled", "skipped"))
    return (ledger.filter("status = 'taken'").select("ledger_id", "channel_id", "video_id")
            .join(clips.filter("status = 'suggested'"), "video_id", "left_semi")
            .join(active, "video_id", "left_anti").join(stopped, "video_id", "left_anti"))


def latest_job(jobs: DataFrame, types: list[str], name: str) -> DataFrame:
    return (jobs.filter(F.col("type").isin(types)).groupBy("video_id")
            .agg(F.max_by("status", "job_id").alias(name)))


def resume_plan(ledger: DataFrame, jobs: DataFrame, listing_names: DataFrame) -> DataFrame:
    """What to do with each taken entry after an interruption."""
    rows = (ledger.filter("status = 'taken'").select("ledger_id", "video_id", "file_name")
            .join(latest_job(jobs, ["analyze", "auto"], "a"), "video_id", "left")
            .join(latest_job(jobs, ["export"], "e"), "video_id", "left")
            .join(listing_names.withColumn("there", F.lit(True)), "file_name", "left"))
    a, e = F.col("a"), F.col("e")
    action = (F.when(e == "done", "close").when(a.isNull() & e.isNull() & F.col("there").isNull(), "unmark")
              .when(e.isin("canceled", "skipped") | a.isin("canceled", "skipped"), "cancel")
              .when(e.isin("pending", "running") | a.isin("pending", "running"), "follow").otherwise("requeue"))
    return rows.select("ledger_id", action.alias("action"))


def expire_claims(ledger: DataFrame, in_use: DataFrame, now: int, hours: int = 12) -> DataFrame:
    """Taken rows older than `hours` and not in use become errors, done now; the note says so after what it said before."""
    busy = in_use.select("video_id").distinct().withColumn("__busy", F.lit(True))
    stale = (F.col("status") == "taken") & (F.col("taken_at") < now - hours * 3600) & F.col("__busy").isNull()
    return (ledger.join(busy, "video_id", "left")
            .withColumn("note", F.when(stale, F.concat(F.coalesce("note", F.lit("")), F.lit(CLAIM_EXPIRED))).otherwise(F.col("note")))
            .withColumn("done_at", F.when(stale, F.lit(now).cast("long")).otherwise(F.col("done_at")))
            .withColumn("status", F.when(stale, "error").otherwise(F.col("status"))).drop("__busy"))


def apply_ledger_events(events: DataFrame) -> DataFrame:
    """Last event of each entry; unmarked entries vanish; notes are cut to 500 characters."""
    return (events.groupBy("channel_id", "file_hash")
            .agg(F.max_by(F.struct("status", "note", "at"), F.struct("at", "event_id")).alias("x"), F.count("*").alias("n"))
            .select("channel_id", "file_hash", "x.status", F.substring("x.note", 1, 500).alias("note"), "x.at", "n")
            .filter("status <> 'unmark'"))


def reconcile(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Job states after an interruption: cancel what was asked, retry, or give up."""
    state = (F.when((F.col("status") == "running") & F.col("cancel_req"), "canceled")
             .when((F.col("status") == "running") & (F.col("attempts") < most), "pending")
             .when(F.col("status") == "running", "failed").otherwise(F.col("status")))
    return jobs.withColumn("status", state)


def last_done(jobs: DataFrame, key: str) -> DataFrame:
    """Newest finish and its job type per key, the higher id on ties."""
    done = jobs.filter("status = 'done' and finished_at is not null")
    return (done.groupBy(key).agg(F.max("finished_at").alias("last_done_at"),
                                  F.max_by("type", F.struct("finished_at", "job_id")).alias("last_done_type")))


def dedup_requests(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Decide each request by its key: drop (done before), join (an active job) or new.

    Of several new requests with one key the first is new and the rest join it.
    """
    past = history.groupBy("dedup_key").agg(
        F.coalesce(F.bool_or(F.col("status") == "done"), F.lit(False)).alias("done"),
        F.coalesce(F.bool_or(F.col("status").isin("pending", "running")), F.lit(False)).alias("active"))
    first = requests.groupBy("dedup_key").agg(F.min("request_id").alias("first_id"))
    action = (F.when(F.coalesce("done", F.lit(False)) & ~F.col("force"), "drop")
              .when(F.coalesce("active", F.lit(False)) | (F.col("request_id") > F.col("first_id")), "join").otherwise("new"))
    return (requests.join(past, "dedup_key", "left").join(first, "dedup_key")
            .select("request_id", "dedup_key", action.alias("action")))


def replace_suggestions(clips: DataFrame, touched: DataFrame, wanted: DataFrame) -> DataFrame:
    """Before a new run over the touched videos: suggestions go unless an active export needs them,
    exported clips become archived."""
    hit = touched.select("video_id").distinct().withColumn("__t", F.lit(True))
    need = wanted.select("clip_id").distinct().withColumn("__w", F.lit(True))
    rows = clips.join(hit, "video_id", "left").join(need, "clip_id", "left")
    gone = F.col("__t").isNotNull() & F.col("__w").isNull() & (F.col("status") == "suggested")
    old = F.col("__t").isNotNull() & F.col("__w").isNull() & F.col("status").isin("exported", "done")
    return (rows.filter(~gone).withColumn("status", F.when(old, "archived").otherwise(F.col("status")))
            .drop("__t", "__w"))


def import_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """One decision per listed file: the id already known for (channel, hash), or the first new file."""
    old = known.groupBy("channel_id", "file_hash").agg(F.min("video_id").alias("old_id"))
    first = listing.groupBy("channel_id", "file_hash").agg(F.min("file_id").alias("first_id"))
    return (listing.join(old, ["channel_id", "file_hash"], "left").join(first, ["channel_id", "file_hash"])
            .select("file_id", F.coalesce("old_id", "first_id").alias("video_id"),
                    (F.col("old_id").isNull() & (F.col("file_id") == F.col("first_id"))).alias("is_new")))


def rename_channels(channels: DataFrame, changes: DataFrame) -> DataFrame:
    """Result of each asked rename: ok, blank, taken (name held by another id) or unknown id."""
    new = F.trim("new_name")
    holders = channels.select(F.col("name").alias("__n"), F.col("channel_id").alias("__holder"))
    first = changes.groupBy(new.alias("__n2")).agg(F.min("channel_id").alias("__first"))
    rows = (changes.withColumn("__n2", new).join(channels.select("channel_id", F.lit(True).alias("known")), "channel_id", "left")
            .join(holders, F.col("__n2") == F.col("__n"), "left")
            .groupBy("channel_id", "__n2", "known").agg(F.bool_or(F.col("__holder") != F.col("channel_id")).alias("held")))
    rows = rows.join(first, "__n2")
    result = (F.when(F.col("known").isNull(), "unknown").when(F.col("__n2") == "", "blank")
              .when(F.coalesce("held", F.lit(False)) | ((F.col("channel_id") > F.col("__first"))), "taken").otherwise("ok"))
    return rows.select("channel_id", F.col("__n2").alias("new_name"), result.alias("result"))


def purge(table: DataFrame, ids: DataFrame, *on: str) -> DataFrame:
    """Rows left after dropping those whose key is in `ids`."""
    return table.join(ids.select(*on).distinct(), list(on), "left_anti")


def keep_newest(df: DataFrame, keys: list[str], order: list[str], chunk: Column, n: int) -> DataFrame:
    """Plan of rows to delete: all but the newest `n` of each key."""
    first = scan(df, keys, order, chunk, __n=running_sum(F.lit(1)))
    total = df.groupBy(*keys).agg(F.count("*").alias("__all"))
    return first.join(total, keys).filter(F.col("__n") <= F.col("__all") - n).drop("__n", "__all")


def evict_oldest(df: DataFrame, keys: list[str], order: list[str], chunk: Column, size: str, most: int) -> DataFrame:
    """Oldest rows to delete until what is left of each key has at most `most` bytes."""
    seen = scan(df, keys, order, chunk, __before=running_sum(F.col(size), False))
    total = df.groupBy(*keys).agg(F.sum(size).alias("__all"))
    return seen.join(total, keys).filter(F.col("__all") - F.col("__before") > most).drop("__before", "__all")


def annotate_clips(clips: DataFrame, edits: DataFrame, clip: str, field: str) -> DataFrame:
    """Clips with one field of their `signals` struct set, and with moved ends: edits are clip, value, start_ms, end_ms.

    A clip without an edit stays as it is; a null value empties the field, null ends stay; a field that the struct lacks is added to all.
    Of several edits of a clip the last by (start_ms, end_ms, value) holds.
    """
    last = edits.groupBy(clip).agg(F.max(F.struct("start_ms", "end_ms", "value")).alias("__e"))
    had = {f.name for f in clips.schema["signals"].dataType.fields}
    old = F.col(f"signals.{field}") if field in had else F.lit(None).cast(edits.schema["value"].dataType)
    value = F.when(F.col("__e").isNotNull(), F.col("__e.value")).otherwise(old)
    moved = clips.join(last, clip, "left")
    return (moved.withColumn("signals", F.col("signals").withField(field, value))
            .withColumn("start_ms", F.coalesce("__e.start_ms", "start_ms")).withColumn("end_ms", F.coalesce("__e.end_ms", "end_ms")).drop("__e"))
