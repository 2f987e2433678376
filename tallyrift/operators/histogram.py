"""The split of the population: one histogram per itemset.

``cells`` holds the target values that occur inside an itemset with the counts on
both sides. A value that never occurs inside has all its transactions on the
counter side, so ``cells`` and ``totals`` together are the complete split, and
the counter side is total minus part: the transactions are joined once."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.operators.itemsets import Encoded, held_by
from tallyrift.session import materialize


SPREAD_SLOTS = 1_000


@dataclass(frozen=True)
class Split:
    itemsets: DataFrame  # set_id, itemset, freq
    cells: DataFrame  # set_id, target, n_set, n_counter
    totals: DataFrame  # target, n_tot
    n: int
    min_count: int  # support it was mined with, in transactions

    def count_at(self, min_support: float) -> int:
        """``min_support`` in transactions; must not be below the mined support."""
        least = math.ceil(min_support * self.n)
        if least < self.min_count:
            raise ValueError(f"mined with at least {self.min_count} of {self.n} transactions, asked for {least}")
        return least

    def at_least(self, min_count: int) -> Split:
        """The same split for a higher support: support only shrinks, so the
        itemsets of a higher threshold are a part of those of a lower one."""
        if min_count < self.min_count:
            raise ValueError(f"mined with at least {self.min_count} transactions, asked for {min_count}")
        kept = self.itemsets.filter(F.col("freq") >= min_count)
        cells = self.cells.join(kept.select("set_id"), "set_id", "left_semi")
        return Split(kept, cells, self.totals, self.n, min_count)


def split_cells(encoded: Encoded, itemsets: DataFrame, count: int, store: bool = True) -> Split:
    """Count every itemset's transactions by target, combined on the map side.
    Without ``store`` the cells are computed in the one plan that reads them."""
    counted = held_by(encoded.rows, itemsets.select(F.col("set_id").alias("at"), "ids"), count, by_target=True)
    cells = counted.join(encoded.totals, "target").select(
        F.col("at").alias("set_id"), "target", F.col("n").alias("n_set"), (F.col("n_tot") - F.col("n")).alias("n_counter")
    )
    if store:
        cells = materialize(cells, "cells")
    return Split(itemsets.select("set_id", "itemset", "freq"), cells, encoded.totals, encoded.n, encoded.min_count)


def full_histogram(split: Split, wanted: DataFrame, slot: str, slots: int) -> DataFrame:
    """``wanted`` itemsets with every target value of the population, zeros
    included: ``wanted`` columns plus ``target, n_set, n_counter``.

    ``slot`` numbers the wanted rows from 0 to ``slots - 1``, which lets each
    total repeat itself per slot and meet its itemset by equality. The output is
    (wanted itemsets x distinct target values) by definition; transactions play
    no part in it any more."""
    totals = split.totals
    if slots > SPREAD_SLOTS:  # few totals would repeat in few tasks
        totals = totals.repartition(totals.sparkSession.sparkContext.defaultParallelism, "target")
    first, last = F.lit(0).cast("bigint"), F.lit(max(slots - 1, 0)).cast("bigint")
    grid = totals.select("target", "n_tot", F.explode(F.sequence(first, last)).alias(slot))
    inside = split.cells.select("set_id", "target", "n_set")
    n_set = F.coalesce("n_set", F.lit(0))
    return (
        grid.join(wanted, slot)
        .join(inside, ["set_id", "target"], "left")
        .select(
            *wanted.columns, "target", n_set.alias("n_set"), (F.col("n_tot") - n_set).alias("n_counter")
        )
    )


def all_histograms(split: Split) -> DataFrame:
    """``full_histogram`` of every itemset of an unfiltered split."""
    return full_histogram(split, split.itemsets, "set_id", split.itemsets.count())
