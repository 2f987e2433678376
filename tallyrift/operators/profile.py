"""Column profiles and record selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_K = 14  # a sketch has 2**LG_K registers of one byte


def category_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every value of every column in whole percent (half to even).
    Counts combine per task, so only distinct values are shuffled."""
    long = rows.select(*[F.col(c).cast("string") for c in columns]).unpivot(
        [], list(columns), "column_name", "category"
    )
    counts = long.groupBy("column_name", "category").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    return (
        counts.filter(F.col("category").isNotNull())
        .join(totals, "column_name")
        .select("column_name", "category", "n", F.bround(F.col("n") * 100.0 / F.col("total"), 0).alias("percent"))
    )


def distinct_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def distinct_sketches(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """One sketch of the distinct values of every column, per group of ``by``: a single pass
    with one fixed-size state per column and task, however many columns and values there are.
    Nulls are not counted, as in ``distinct_counts``; values are told apart by their text."""
    values = [F.hll_sketch_agg(F.col(c).cast("string"), lg_k).alias(c) for c in columns]
    return rows.groupBy(*by).agg(*values)


def merge_sketches(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Stored sketches of parts (days, partitions, databases) as sketches of the whole; the
    parts are not read again, and overlapping parts count their common values once."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c).alias(c) for c in columns])


def sketch_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate from merged sketches."""
    return 1.04 / (1 << lg_k) ** 0.5


def sketch_counts(sketches: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by.., column_name, estimate``; no rows counted give 0."""
    estimates = [F.coalesce(F.hll_sketch_estimate(c), F.lit(0).cast("bigint")).alias(c) for c in columns]
    return sketches.select(*by, *estimates).unpivot(list(by), list(columns), "column_name", "estimate")


def columns_without_nulls(rows: DataFrame) -> list[str]:
    """Names of the columns that hold no null, from one pass."""
    nulls = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns]).first()
    return [c for c in rows.columns if nulls[c] == 0]


def drop_null_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*columns_without_nulls(rows))


def earliest_records(rows: DataFrame, key: str, time: str) -> DataFrame:
    """All records at the earliest ``time`` of their ``key``, ties included.

    ``rows`` are read once. Spark turns a rank of at most 1 into a limit per key before and
    after the shuffle, so a task sends only what may be earliest, however busy a key is, and the
    window holds nothing but the ties. Rows that are already dealt by ``key`` stay where they are."""
    first = F.rank().over(Window.partitionBy(key).orderBy(time))
    known = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    return known.withColumn("_rank", first).filter(F.col("_rank") <= 1).drop("_rank").select(key, time, *[c for c in rows.columns if c not in (key, time)])


def long_to_sets(rows: DataFrame, key: str, sets: Sequence[str], singles: Sequence[str]) -> DataFrame:
    """One row per key: sorted sets of some columns, the smallest value of others."""
    return rows.groupBy(key).agg(
        *[F.array_sort(F.collect_set(c)).alias(c) for c in sets], *[F.min(c).alias(c) for c in singles]
    )
