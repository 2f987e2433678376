"""Transactions: ``items array<string>, target bigint, weight bigint``.

``weight`` counts the identical source rows a transaction stands for, so flat
tables shrink to their distinct combinations before anything else happens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(column: str, name: str | None = None, style: str = "column=value") -> Column:
    """One categorical value as an item; a null value gives a null item."""
    name = name or column
    value = F.col(column).cast("string")
    if style == "column=value":
        return F.concat(F.lit(f"{name}="), value)
    if style == "value_column":
        return F.concat(value, F.lit(f"_{name}"))
    raise ValueError(f"unknown item style: {style}")


def whole(target: Column) -> Column:
    """A numeric target as bigint. A fraction ends the job: bin it while preparing the
    transactions, cutting it here would move values silently."""
    value = target.cast("double")
    cut = F.raise_error(F.concat(F.lit("target is no whole number: "), target.cast("string"))).cast("bigint")
    return F.when(value == F.floor(value), target.cast("bigint")).when(target.isNotNull(), cut)


def from_columns(
    rows: DataFrame, item_columns: Sequence[str], target: str, style: str = "column=value"
) -> DataFrame:
    """One transaction per distinct (item columns, target) with its row count.

    The count is combined on the map side, so the shuffle carries at most one
    row per combination and task, however often a combination repeats."""
    counted = (
        rows.filter(F.col(target).isNotNull())
        .groupBy(*item_columns, whole(F.col(target)).alias("target"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    items = F.array_compact(F.array(*[tag(c, style=style) for c in item_columns]))
    return counted.select(F.array_sort(items).alias("items"), "target", "weight")


def from_facts(
    facts: DataFrame, key: str | Sequence[str], item_columns: Mapping[str, str], target: Column
) -> DataFrame:
    """One transaction per ``key``: the distinct values of every column in
    ``item_columns`` (column -> item prefix) and an aggregated ``target``.

    Sets are merged on the map side first, so a key that owns a large share of
    the rows sends one set per task, bounded by the distinct items."""
    keys = [key] if isinstance(key, str) else list(key)
    sets = [
        F.collect_set(tag(column, prefix)).alias(f"_set{i}")
        for i, (column, prefix) in enumerate(item_columns.items())
    ]
    grouped = facts.groupBy(*keys).agg(*sets, target.alias("_target"))
    items = F.flatten(F.array(*[F.col(f"_set{i}") for i in range(len(sets))]))
    return grouped.filter(F.col("_target").isNotNull()).select(
        F.array_sort(items).alias("items"), whole(F.col("_target")).alias("target"), F.lit(1).cast("bigint").alias("weight")
    )


def keep_marked_items(items: Column | str, marker: str = "_") -> Column:
    """Only the items that contain ``marker``; drops a bare number such as the
    target when a whole row was turned into an array."""
    column = F.col(items) if isinstance(items, str) else items
    return F.filter(column, lambda item: F.contains(item, F.lit(marker)))
