"""Queries by name, with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
# DuckDB counts and sums these columns as 128-bit numbers; Spark as 64-bit ones.
WIDE = {
    "cap_total_length": "e_ms", "loudest_hook": "loud", "daily_mix": "done error taken",
    "queue_counts": "analyzing exporting waiting waiting_analyze waiting_export done failed",
    "channel_activity": "running pending failed_24h run_export exported",
    "video_activity": "running pending failed_24h run_export",
    "channel_period_stats": "done_today errors_today done_yesterday errors_yesterday done_7d errors_7d done_30d errors_30d",
    "outcome_summary": "by_model basic", "intake_today": "taken_today", "job_wait_stats": "over_10min",
    "channel_board": "running failed_24h done errors", "junk_report": "cta greeting promo",
    "proportional_cues": "a b", "chars_to_words": "a b", "tumbling_status_counts": "done failed", "role_changes": "changes",
}
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""
    def put(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            casts = ", ".join(f"cast({c} as bigint) as {c}" for c in WIDE.get(key, "").split())
            ORACLE[key] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return fn
    return put
