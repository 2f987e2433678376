"""From transactions to ranked rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.operators import measures
from tallyrift.operators.histogram import Split, split_cells
from tallyrift.operators.itemsets import encode, mine
from tallyrift.operators.ranking import top_rules
from tallyrift.operators.topk import best_split

MEASURES = ("kl", "expo", "normal", "mean")


def split_population(
    transactions: DataFrame, min_support: float, miner: str = "levels", store: bool = True
) -> Split:
    """Mine the frequent itemsets and split the target values at each of them."""
    encoded = encode(transactions, min_support)
    return split_cells(encoded, *mine(encoded, miner), store)


def score_rules(
    split: Split,
    measure: str,
    fit_threshold: float | None = None,
    formula: str = "squared_variance",
    require_counter: bool = True,
    significant: bool = False,
) -> DataFrame:
    """Every itemset with its score. ``fit_threshold`` keeps rules whose sides
    both lie close to their fitted curve; ``significant`` keeps mean differences
    with |z| > 1.96. A rule without a score compares nothing and is dropped."""
    if measure == "kl":
        scored = measures.discrete_divergence(split)
    elif measure == "mean":
        scored = measures.mean_difference(split)
        if significant:
            scored = scored.filter(F.abs("z") > 1.96)
    elif measure == "expo":
        scored = measures.exponential_divergence(split)
    elif measure == "normal":
        scored = measures.normal_divergence(split, fit_threshold, formula)
    else:
        raise ValueError(f"measure must be one of {MEASURES}")
    if fit_threshold is not None and measure in ("expo", "normal"):
        scored = scored.filter(
            (F.col("fit_set") <= fit_threshold) & (F.col("fit_counter") <= fit_threshold)
        )
    if require_counter:
        scored = scored.filter((F.col("n_counter") > 0) & F.col("score").isNotNull())
    return scored.withColumn("measure", F.lit(measure))


def discover_rules(
    transactions: DataFrame,
    min_support: float,
    measure: str = "kl",
    k: int = 10,
    miner: str = "levels",
    **scoring,
) -> DataFrame:
    """The ``k`` best rules of ``transactions`` under ``measure``."""
    split = split_population(transactions, min_support, miner, store=measure == "normal")
    return top_rules(score_rules(split, measure, **scoring), k)


def discover_best(transactions: DataFrame, min_support: float, measure: str = "mean", k: int = 10) -> tuple[DataFrame, list[dict[str, int]]]:
    """The ``k`` best rules as ``discover_rules`` gives them, for ``mean`` or ``expo``, without
    counting what cannot be among them, and how many itemsets of each size were visited."""
    split, visited = best_split(encode(transactions, min_support), measure, k)
    return top_rules(score_rules(split, measure), k), visited
