"""Preparation of flat tables: filter, clean, tag every categorical column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.operators.profile import drop_null_columns
from tallyrift.operators.transactions import from_columns, tag


def clean_flat(rows: DataFrame, keep: Column, drop: Sequence[str], nulls: str = "rows") -> DataFrame:
    """Rows that satisfy ``keep`` without the ``drop`` columns. Nulls either
    remove their row afterwards or, before filtering, their whole column."""
    if nulls == "rows":
        return rows.filter(keep).drop(*drop).na.drop()
    if nulls == "columns":
        return drop_null_columns(rows).filter(keep).drop(*drop)
    raise ValueError("nulls must be 'rows' or 'columns'")


def tag_columns(rows: DataFrame, target: str) -> DataFrame:
    """Every column but the target as ``value_column``."""
    return rows.select(*[F.col(c) if c == target else tag(c, style="value_column").alias(c) for c in rows.columns])


def flat_to_transactions(rows: DataFrame, target: str) -> DataFrame:
    """Transactions of a cleaned flat table, items as ``value_column``."""
    return from_columns(rows, [c for c in rows.columns if c != target], target, "value_column")
