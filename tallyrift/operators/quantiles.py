"""Exact weighted quantiles of groups, however large one group or its values are.

Values are counted, sorted by ranges over (group, value), and summed up inside each range;
sums of the ranges before give every value its place. No task holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.operators import ranking
from tallyrift.session import materialize


def weighted_quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """``keys`` and ``quantiles``, an array in the order of ``shares``, interpolated between
    neighbouring places (type 7), as if every value stood there ``weight`` times. Null values
    and weights below 1 are left out, null keys are a group. Equal inputs give equal results.

    Up to ``SINGLE_TASK_ROWS`` distinct values, counted first, groups are summed up whole."""
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    x = F.col(value).cast("double")
    counted = materialize(
        rows.where(x.isNotNull() & (F.lit(True) if weight is None else F.col(weight) > 0))
        .groupBy(*keys, x.alias("_x")).agg(count.cast("bigint").alias("_n")), "counted"
    )
    if counted.count() <= ranking.SINGLE_TASK_ROWS:
        ranged = counted.withColumn("_range", F.lit(0))
    else:
        ranged = materialize(counted.repartitionByRange(*keys, "_x").withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_total": F.sum("_size").over(whole), "_offset": F.coalesce(F.sum("_size").over(before), F.lit(0))})
    known = sizes.select("_range", "_total", "_offset", *(F.col(k).alias(f"_of_{k}") for k in keys))
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    part = Window.partitionBy(*keys, "_range").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_up_to", F.sum("_n").over(part)).join(known.withColumnRenamed("_range", "_at"), same)
    last, first = F.col("_offset") + F.col("_up_to"), F.col("_offset") + F.col("_up_to") - F.col("_n")

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place < last), F.col("_x")))

    found = []
    for i, share in enumerate(shares):
        exact = (F.col("_total") - 1) * F.lit(float(share))
        low = F.floor(exact)
        found += [at(low).alias(f"_low{i}"), at(F.least(low + 1, F.col("_total") - 1)).alias(f"_high{i}"), F.max(exact - low).alias(f"_part{i}")]
    ends = summed.groupBy(*keys).agg(*found)
    between = [F.col(f"_low{i}") + F.col(f"_part{i}") * (F.col(f"_high{i}") - F.col(f"_low{i}")) for i in range(len(shares))]
    return ends.select(*keys, F.array(*between).alias("quantiles"))
