"""Spark side and SQL side of every named query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def num(column: Column | str, name: str | None = None, digits: int = 6) -> Column:
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    value = F.col(column) if isinstance(column, str) else column
    return (F.round(value, digits) + F.lit(0.0)).alias(name or column)


def text(column: str = "itemset") -> Column:
    return F.array_join(column, "|").alias(column)


def show_rules(rules: DataFrame, *more: Column) -> DataFrame:
    return rules.select("rank", text(), "freq", "n_counter", num("mean"), num("score"), *more)
