"""Global order without a global task: row numbers, top-k, top share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.session import materialize

SINGLE_TASK_ROWS = 100_000


def number_rows(df: DataFrame, order: Sequence[Column], name: str, rows: int | None = None) -> DataFrame:
    """Add the 0-based position of every row in ``order`` (a total order).
    ``df`` is read twice, so pass a stored table; ``rows`` is its size if known.

    Up to ``SINGLE_TASK_ROWS`` rows, measured first, one sort does it. Beyond
    that rows are range partitioned, numbered inside their range and shifted by
    the sizes of the ranges before; only one count per range meets in a task."""
    if (df.count() if rows is None else rows) <= SINGLE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)
    ranged = materialize(
        df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")  # one row per range
        .withColumn(name, (F.col("_offset") + F.col("_inside") - 1).cast("bigint"))
        .drop("_range", "_inside", "_offset")
    )


def number_within(df: DataFrame, setting: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position of every row inside its ``setting`` and the setting's
    ``size``. All settings are numbered together in one order, and the rows of the settings
    before are taken off, so neither jobs nor plan grow with the settings, and a large setting
    is numbered by ranges like any table. ``df`` is read twice, so pass a stored table."""
    sizes = df.groupBy(*setting).agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(*setting).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    numbered = number_rows(df, [*[F.col(c) for c in setting], *order], name)
    return numbered.join(sizes, list(setting)).withColumn(name, F.col(name) - F.col("_before")).drop("_before")


def score_order(score: str = "score", tie_break: str = "itemset") -> list[Column]:
    """Best score first. Sums arrive in no fixed order on a cluster, so scores
    equal to 12 decimals count as ties and the itemset decides."""
    return [F.round(F.col(score), 12).desc_nulls_last(), F.col(tie_break)]


def top_rules(scored: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best rules with their 1-based ``rank``. ``orderBy`` plus
    ``limit`` keeps k rows per task; only those are numbered."""
    best = scored.orderBy(*score_order()).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*score_order())))


def top_percent(rules: DataFrame, percent: float) -> DataFrame:
    """The best ``percent`` of all rules, rounded down; ``rules`` is a stored table."""
    count = rules.count()
    keep = int(count * (percent / 100))
    if keep >= count:
        return rules
    numbered = number_rows(rules, score_order(), "_position", count)
    return numbered.filter(F.col("_position") < keep).drop("_position")
