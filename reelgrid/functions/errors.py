"""Error text of calls and jobs: waiting time and class."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TOKEN = r"(\d+(?:\.\d+)?)\s*(ms|h|m|s)"


def retry_wait_s(text: Column) -> Column:
    """Seconds to wait named in an error ("in 7m30.5s", "retry-after: 30"); NULL without one."""
    t = F.lower(text)
    part = F.regexp_extract(t, r"\bin\s+((?:\d+(?:\.\d+)?\s*(?:ms|h|m|s)\s*)+)", 1)
    amounts = F.regexp_extract_all(part, F.lit(_TOKEN), F.lit(1))
    units = F.regexp_extract_all(part, F.lit(_TOKEN), F.lit(2))
    factor = F.create_map(F.lit("ms"), F.lit(0.001), F.lit("s"), F.lit(1.0), F.lit("m"), F.lit(60.0),
                          F.lit("h"), F.lit(3600.0))
    total = F.aggregate(F.arrays_zip(amounts.alias("a"), units.alias("u")), F.lit(0.0),
                        lambda acc, x: acc + x["a"].cast("double") * F.element_at(factor, x["u"]))
    after = F.regexp_extract(t, r"retry[-_ ]?after\D{0,4}(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.coalesce(F.when(total > 0, total), F.when(after > 0, after))


def _has(t: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | t.contains(p)
    return out


def error_class(text: Column) -> Column:
    """auth, restricted, too_large, day, minute, rate, transient or other."""
    t, wait = F.lower(text), retry_wait_s(text)
    auth = _has(t, "invalid_api_key", "invalid api key", "401", "unauthorized", "authentication",
                "no auth credentials", "api key not valid")
    restricted = _has(t, "organization_restricted") | (t.contains("organization") & t.contains("restricted"))
    large = (t.contains("413") & t.contains("too large")) | t.contains("reduce your message size")
    limited = _has(t, "429", "quota", "rate limit", "ratelimit", "rate_limit", "resource_exhausted",
                   "too many requests")
    day = _has(t, "per day", "daily", "tpd", "rpd", "per-day")
    transient = _has(t, "timeout", "timed out", "connection", "connect", "temporarily unavailable",
                     "service unavailable", "internal server error", "bad gateway", "error code: 5",
                     "remote end closed", "incomplete read", "reset by peer", "aborted", "eof occurred", "ssl")
    return (F.when(text.isNull(), F.lit(None)).when(auth, "auth").when(restricted, "restricted").when(large, "too_large")
            .when(limited, F.when(day | (wait > 120), "day").when(wait <= 120, "minute").otherwise("rate"))
            .when(transient, "transient").otherwise("other"))
