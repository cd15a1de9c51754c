"""Running values along a timeline, safe when one key owns a large share of the rows.

A window partitioned by the key alone sends a hot key to a single task. Here every key
is cut into chunks of its timeline: rows are scanned inside (key, chunk), each chunk is
summarised to one row, the summaries are scanned per key, and the carry of the earlier
chunks is joined back. Only the summaries (one row per chunk) meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, 0)


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is count, sum, max or last (last non-null)."""

    kind: str
    value: Column
    inclusive: bool
    backward: bool = False


def row_number() -> Running:
    return Running("sum", F.lit(1).cast("long"), True)


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Running:
    """Last non-null value seen so far."""
    return Running("last", value, inclusive)


def next_value(value: Column) -> Running:
    """First non-null value strictly after the row."""
    return Running("last", value, False, True)


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
         **runs: Running) -> DataFrame:
    """Add one column per running value.

    `order` must be a total order inside a key and `chunk` a non-decreasing function of it.
    """
    group = [*keys, "__chunk"]
    base = df.withColumn("__chunk", chunk)
    forward = W.partitionBy(*group).orderBy(*order)
    reverse = W.partitionBy(*group).orderBy(*[F.col(o).desc() for o in order])
    position = F.struct(*order)

    local, totals, carries = [], [], []
    for name, run in runs.items():
        span = _UP_TO if run.inclusive else _BEFORE
        rows = (reverse if run.backward else forward).rowsBetween(*span)
        side = F.col("__chunk").desc() if run.backward else F.col("__chunk").asc()
        earlier = W.partitionBy(*keys).orderBy(side).rowsBetween(*_BEFORE)
        total = F.col(f"__t_{name}")
        if run.kind == "sum":
            local.append(F.sum(run.value).over(rows).alias(f"__l_{name}"))
            totals.append(F.sum(run.value).alias(f"__t_{name}"))
            carries.append(F.sum(total).over(earlier).alias(f"__c_{name}"))
        elif run.kind == "max":
            local.append(F.max(run.value).over(rows).alias(f"__l_{name}"))
            totals.append(F.max(run.value).alias(f"__t_{name}"))
            carries.append(F.max(total).over(earlier).alias(f"__c_{name}"))
        else:
            seen = F.when(run.value.isNotNull(), position)
            pick = F.min_by if run.backward else F.max_by
            local.append(F.last(run.value, True).over(rows).alias(f"__l_{name}"))
            totals.append(pick(run.value, seen).alias(f"__t_{name}"))
            carries.append(F.last(total, True).over(earlier).alias(f"__c_{name}"))

    # null keys and null times are groups like any other
    carry = base.groupBy(*group).agg(*totals).select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *carries)
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    joined = base.select("*", *local).join(carry, reduce(Column.__and__, same))
    out = [F.col(c) for c in df.columns]
    for name, run in runs.items():
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if run.kind == "sum":
            value = F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif run.kind == "max":
            value = F.greatest(before, here)
        else:
            value = F.coalesce(here, before)
        out.append(value.alias(name))
    return joined.select(*out)


def time_chunk(column: str, width: int) -> Column:
    """Chunk number of a time column for `scan`."""
    return F.floor(F.col(column) / F.lit(width))
