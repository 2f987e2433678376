"""Named queries over the given tables, with the SQL that must agree."""

from __future__ import annotations

from tallyrift.catalog import (  # noqa: F401  (importing registers)
    comparison_queries,
    mining_queries,
    preparation_queries,
    registry,
    report_queries,
)


def all_queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
