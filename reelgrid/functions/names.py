"""File-name expressions: download leftovers, exported parts, titles and safe names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelgrid.sources.tables import VIDEO_EXTENSIONS

# Suffixes of unfinished downloads.
UNFINISHED = ["part", "ytdl", "tmp", "crdownload", "aria2", "frag"]


def file_state(name: Column, size: Column, mtime: Column, now: int, stable_s: int = 30) -> Column:
    """ready, busy, tmp, part, zero_old or other; checked in that file-kind order."""
    old = F.lit(now) - mtime >= stable_s
    video = name.rlike(r"(?i)\.(" + "|".join(VIDEO_EXTENSIONS) + ")$")
    tmp = name.rlike(r"(?i)\.(" + "|".join(UNFINISHED) + r")$|\.f\d+\.[^.]*$")
    return (F.when(~video, F.when(tmp, "tmp").otherwise("other")).when(tmp, "tmp")
            .when(name.rlike(r"(?i)^part\s*\d"), "part").when((size > 0) & old, "ready")
            .when((size == 0) & old, "zero_old").otherwise("busy"))


def title_from_file(name: Column) -> Column:
    t = F.regexp_replace(name, r"\.[^.]*$", "")
    t = F.regexp_replace(t, r"(?i)\s*[-–]\s*YouTube\s*$", "")
    t = F.regexp_replace(t, r"\s*\[[0-9a-zA-Z_-]{8,}\]\s*$", "")
    t = F.regexp_replace(t, r"(?i)\s*\(?\b(1080|720|2160|480)p\b\)?", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[\s_]+", " "), r"^[ \-_.]+|[ \-_.]+$", "")
    return F.when(F.length(t) > 90, F.concat(F.rtrim(F.substring(t, 1, 90)), F.lit("…"))).otherwise(t)


def safe_name(text: Column, limit: int = 70) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|\r\n\t]', ""), r"\s+", " "))
    return F.regexp_replace(F.trim(F.substring(t, 1, limit)), r"^[. ]+|[. ]+$", "")
