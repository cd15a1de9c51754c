"""Local-day logic on epoch seconds, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, functions as F


def wall_clock(seconds: Column, tz: str = "UTC") -> Column:
    """Zone-free timestamp of epoch seconds as seen in `tz`."""
    utc = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01'"))
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def local_day(seconds: Column, tz: str = "UTC") -> Column:
    return wall_clock(seconds, tz).cast("date")


def midnight(now: int, tz: str) -> int:
    """Epoch seconds of the last local midnight before `now`."""
    day = datetime.fromtimestamp(now, ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0)
    return int(day.timestamp())


def parse_epoch(text: Column) -> Column:
    """Epoch seconds of a stored time: a number as text or an ISO time in UTC; NULL when unreadable."""
    plain = F.regexp_replace(F.trim(text), "Z$", "").try_cast("timestamp_ntz")
    return F.coalesce(F.trim(text).try_cast("double").cast("long"),
                      F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01'"), plain))


def leading_int(text: Column) -> Column:
    """Numeric prefix of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def relative_time(seconds: Column, now: int) -> Column:
    """Rough age of a time: now, minutes, hours, yesterday, days."""
    age = F.greatest(F.lit(0), F.lit(now) - seconds)
    return (F.when(seconds.isNull(), "").when(age < 90, "just now")
            .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit(" min")))
            .when(age < 86_400, F.concat(F.floor(age / 3600).cast("string"), F.lit(" h")))
            .when(age < 172_800, "yesterday")
            .otherwise(F.concat(F.floor(age / 86_400).cast("string"), F.lit(" days"))))
