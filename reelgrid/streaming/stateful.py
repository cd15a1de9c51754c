"""Intake rules with state that leaves: value and list state, timers, time to live.

Each key (a hash, a request, a path) owns a little state. Events of a key wait in list state until the watermark has passed
them and are then judged in order of (time, seq), so lateness within the watermark changes nothing, and a batch is never
sorted as a whole. A timer lets a key's state go when it was quiet for `keep`; in processing time, time to live does so.
The rules are those of `intake`, and `ordered_rule` runs them over a table.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelgrid.operators.folds import fold_runs
from reelgrid.streaming.intake import accept_once, decide_request

#: rule(state, kind, force) -> what to tell of an event, or None
Rule = Callable[[dict, str, bool], str | None]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def take_rule(state: dict, kind: str, force: bool) -> str | None:
    return "taken" if accept_once(state, kind) else None


def request_rule(state: dict, kind: str, force: bool) -> str | None:
    return decide_request(state, kind, force)


def _millis(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=at.tzinfo or dt.timezone.utc).timestamp() * 1000)


class _InOrder(StatefulProcessor):
    """Holds events until the watermark has passed them, then applies a rule in order."""

    def __init__(self, keys: list[str], rule: Rule, keep_ms: int) -> None:
        self._keys, self._rule, self._keep_ms = keys, rule, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "at long, seq long, kind string, force boolean")
        self._status = handle.getValueState("status", "status string, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            at = _millis(row.ts)
            self._waiting.appendValue((at, row.seq, row.kind, bool(row.force)))
            self._handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self._waiting.get()) if self._waiting.exists() else []
        due = sorted((e for e in held if e[0] <= now), key=lambda e: (e[0], e[1]))
        known = self._status.get() if self._status.exists() else None
        out: list[Row] = []
        state = {"status": known[0]} if known else {}
        for at, seq, kind, force in due:
            told = self._rule(state, kind, force)
            if told is not None:
                out.append(Row(**dict(zip(self._keys, key)), seq=seq, action=told))
        if due:
            until = due[-1][0] + self._keep_ms
            self._status.update((state.get("status"), until))
            self._handle.registerTimer(until)
            later = [tuple(e) for e in held if e[0] > now]
            if later:
                self._waiting.put(later)
            else:
                self._waiting.clear()
        elif known and known[1] <= now:                        # quiet for long enough
            self._status.clear()
        return iter(out)

    def close(self) -> None:
        pass


def ordered_stream(events: DataFrame, keys: list[str], rule: Rule, late: str = "1 hour", keep: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """keys, seq, action of the events a rule tells of. `events`: keys, seq, kind, force, ts; needs the RocksDB state store (`PROVIDER`)."""
    out = T.StructType([*(events.schema[k] for k in keys), T.StructField("seq", T.LongType()), T.StructField("action", T.StringType())])
    return (events.withWatermark("ts", late).groupBy(*keys).transformWithState(
        _InOrder(keys, rule, int(keep.total_seconds() * 1000)), out, "append", "EventTime"))


def ordered_rule(events: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """The same rule over a table of all events: keys, seq, action."""
    told = fold_runs(events, keys, ["ts", "seq"], ["kind", "force"], dict, lambda s, kind, force: rule(s, kind, bool(force)), "action", T.StringType())
    return told.filter("action is not null").select(*keys, "seq", "action")


class _Stable(StatefulProcessor):
    """Tells of a path once, when its file is old enough and not empty."""

    def __init__(self, age_ms: int, sightings: int, keep_ms: int) -> None:
        self._age_ms, self._sightings, self._keep_ms = age_ms, sightings, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._file = handle.getValueState("file", "size long, mtime long, seen int, told boolean", self._keep_ms)

    def _judged(self, key, now: int, size: int, mtime: int, seen: int, told: bool) -> Iterator[Row]:
        ready = size > 0 and now - mtime >= self._age_ms and seen >= self._sightings
        self._file.update((size, mtime, seen, told or ready))
        if not ready:
            self._handle.registerTimer(max(now + 1, mtime + self._age_ms))
        return iter([Row(channel=key[0], path=key[1], size=size)] if ready and not told else [])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        size, mtime, seen, told = self._file.get() if self._file.exists() else (-1, 0, 0, False)
        for row in rows:
            seen = seen + 1 if row.size == size else 1
            size, mtime = row.size, max(mtime, _millis(row.mtime))
        return self._judged(key, timerValues.getCurrentProcessingTimeInMs(), size, mtime, seen, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self._file.exists():
            return iter(())
        size, mtime, seen, told = self._file.get()
        if told or size <= 0 or seen < self._sightings:        # only a new sighting can change this
            return iter(())
        return self._judged(key, timerValues.getCurrentProcessingTimeInMs(), size, mtime, seen, told)

    def close(self) -> None:
        pass


def stable_files(listing: DataFrame, age_s: int = 30, two_sightings: bool = False, keep: dt.timedelta = dt.timedelta(days=7)) -> DataFrame:
    """channel, path, size of each path once, when it is `age_s` old and not empty (and seen twice with one size if asked); a path
    not seen for `keep` is forgotten. `listing`: channel, path, size, mtime."""
    return listing.groupBy("channel", "path").transformWithState(
        _Stable(age_s * 1000, 2 if two_sightings else 1, int(keep.total_seconds() * 1000)),
        "channel string, path string, size long", "append", "ProcessingTime")
