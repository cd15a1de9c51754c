"""The derived base tables themselves, checked against their SQL."""

from __future__ import annotations

from reelgrid.plans.registry import query
from reelgrid.sources.standins import TABLES, with_tables


def _register(name: str) -> None:
    def read(spark, folder):
        return TABLES[name](spark, folder)
    query(with_tables(f"select * from {name}", name), f"table_{name}")(read)


for _name in TABLES:
    _register(_name)
