"""Intake as streams: stable files once, accepted hashes, expiring claims, daily quota, requests.

State is kept per file, hash, claim, (channel, day) or request key, so a busy channel spreads over
many keys. Timeouts let old state go.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgrid.functions.names import UNFINISHED
from reelgrid.sources.tables import VIDEO_EXTENSIONS


def media_listing_stream(spark: SparkSession, root: str) -> DataFrame:
    """New video files below `root`/channel as they appear; contents are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = ",".join(f"{e},{e.upper()}" for e in VIDEO_EXTENSIONS)
    tmp = r"(?i)\.(" + "|".join(UNFINISHED) + r")$|\.f\d+\.[^.]*$|/part\s*\d[^/]*$"
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.{" + ext + "}").load(root)
            .select(F.element_at(F.split("path", "/"), -2).alias("channel"), "path", name.alias("name"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(~F.col("path").rlike(tmp)))


def stable_files(listing: DataFrame, age_s: int = 30, two_sightings: bool = False) -> DataFrame:
    """Each path once, when it is `age_s` old and not empty (and seen twice with one size if asked)."""
    out = "channel string, path string, size long"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        size, mtime, seen, sent = state.get if state.exists else (-1, 0, 0, False)
        for b in batches:
            for z, m in zip(b["size"], b["mtime"]):
                seen = seen + 1 if z == size else 1
                size, mtime = int(z), max(mtime, int(m.timestamp() * 1000))
        ready = size > 0 and now - mtime >= age_s * 1000 and seen >= (2 if two_sightings else 1)
        fire = ready and not sent
        state.update((size, mtime, seen, bool(sent or ready)))
        if not ready:
            state.setTimeoutDuration(max(1000, mtime + age_s * 1000 - now))
        if fire:
            yield pd.DataFrame({"channel": [key[0]], "path": [key[1]], "size": [size]})

    return listing.groupBy("channel", "path").applyInPandasWithState(
        go, out, "size long, mtime long, seen int, sent boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def accept_once(state: dict, kind: str) -> bool:
    """A hash is accepted when it is new or its last attempt failed; `kind` is take, done or error."""
    if kind == "take":
        fresh = state.get("status") in (None, "error")
        if fresh:
            state["status"] = "taken"
        return fresh
    state["status"] = kind
    return False


def dedup_stream(events: DataFrame) -> DataFrame:
    """Accepted take events of (channel_id, file_hash, seq, kind); an error opens the hash again."""
    out = "channel_id long, file_hash string, seq long"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {"status": state.get[0]} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = [accept_once(held, k) for k in rows["kind"]]
        state.update((held.get("status"),))
        yield rows.loc[keep, ["channel_id", "file_hash", "seq"]]

    return events.groupBy("channel_id", "file_hash").applyInPandasWithState(
        go, out, "status string", "append", GroupStateTimeout.NoTimeout)


def dedup_bounded(events: DataFrame, late: str = "7 days") -> DataFrame:
    """The plain case without reopening: first event of a hash within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["channel_id", "file_hash"])


def expiring_claims(events: DataFrame, hours: int = 12, late: str = "1 hour") -> DataFrame:
    """Claims not finished `hours` after they were taken, by event time."""
    out = "ledger_id long, expired_at timestamp"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0]
            state.remove()
            yield pd.DataFrame({"ledger_id": [key[0]], "expired_at": [pd.Timestamp(due, unit="ms")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        due = state.get[0] if state.exists else None
        for kind, ts in zip(rows["kind"], rows["ts"]):
            due = int(ts.timestamp() * 1000) + hours * 3_600_000 if kind == "take" else None
        if due is None:
            if state.exists:
                state.remove()
        elif due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"ledger_id": [key[0]], "expired_at": [pd.Timestamp(due, unit="ms")]})
        else:
            state.update((due,))
            state.setTimeoutTimestamp(due)

    return (events.withWatermark("ts", late).groupBy("ledger_id").applyInPandasWithState(
        go, out, "due long", "append", GroupStateTimeout.EventTimeTimeout))


def daily_quota(files: DataFrame, late: str = "1 day") -> DataFrame:
    """At most `daily` files per channel and local day; 0 and 1 mean no limit.

    `files`: channel_id, day (epoch day), seq, daily, ts. Counters leave two days after their day.
    """
    out = "channel_id long, day long, seq long"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        keep = []
        for limit in rows["daily"]:
            ok = limit < 2 or used < limit
            used += int(ok)
            keep.append(bool(ok))
        state.update((used,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(key[1]) + 3) * 86_400_000))
        yield rows.loc[keep, ["channel_id", "day", "seq"]]

    return (files.withWatermark("ts", late).groupBy("channel_id", "day").applyInPandasWithState(
        go, out, "used int", "append", GroupStateTimeout.EventTimeTimeout))


def decide_request(state: dict, kind: str, force: bool) -> str | None:
    """new, join or drop for a request; status events only move the state."""
    if kind != "request":
        state["status"] = kind
        return None
    status = state.get("status")
    if status == "done" and not force:
        return "drop"
    if status in ("pending", "running"):
        return "join"
    state["status"] = "pending"
    return "new"


def request_stream(events: DataFrame) -> DataFrame:
    """Decisions over (dedup_key, seq, kind, force) requests and status events of each key."""
    out = "dedup_key long, seq long, action string"

    def go(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {"status": state.get[0]} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("seq")
        rows["action"] = [decide_request(held, k, f) for k, f in zip(rows["kind"], rows["force"])]
        state.update((held.get("status"),))
        yield rows.loc[rows["action"].notna(), ["dedup_key", "seq", "action"]]

    return events.groupBy("dedup_key").applyInPandasWithState(
        go, out, "status string", "append", GroupStateTimeout.NoTimeout)
