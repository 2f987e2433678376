"""Tables behind the distribution plots and summaries of the best rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.functions import stats
from tallyrift.operators.bootstrap import bootstrap_error, checked_error
from tallyrift.operators.histogram import Split, full_histogram
from tallyrift.operators.itemsets import repeat_rows
from tallyrift.operators.quantiles import weighted_quantiles
from tallyrift.operators.ranking import score_order
from tallyrift.plans.discovery import score_rules
from tallyrift.session import materialize


def rule_histograms(split: Split, rules: DataFrame, ranks: int = 2) -> DataFrame:
    """Full histograms of the best ``ranks`` rules: ``rank, itemset, target,
    n_set, n_counter``. Stored, because every report reads them several times."""
    wanted = rules.filter(F.col("rank") <= ranks).select(
        "set_id", "rank", "itemset", (F.col("rank") - 1).cast("bigint").alias("slot")
    )
    return materialize(full_histogram(split, wanted, "slot", ranks).drop("slot", "set_id"), "best")


def sides(histograms: DataFrame) -> DataFrame:
    """Both sides below each other: ``rank, side, target, n``, present values only."""
    return (
        histograms.select("rank", "target", F.col("n_set").alias("set"), F.col("n_counter").alias("counter_set"))
        .unpivot(["rank", "target"], ["set", "counter_set"], "side", "n")
        .filter(F.col("n") > 0)
    )


def side_moments(histograms: DataFrame) -> DataFrame:
    """Size, mean and sample variance of each side."""
    long = sides(histograms)
    x = F.col("target").cast("double")
    means = long.groupBy("rank", "side").agg(
        F.sum("n").alias("support"),
        (F.sum(x * F.col("n")) / F.sum("n")).alias("mean"),
    )
    squares = (
        long.join(means.select("rank", "side", "mean"), ["rank", "side"])
        .groupBy("rank", "side")
        .agg(F.sum(F.col("n") * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares"))
    )
    return means.join(squares, ["rank", "side"]).select(
        "rank",
        "side",
        "support",
        "mean",
        (F.col("squares") / F.nullif(F.col("support") - 1, F.lit(0))).alias("variance"),
    )


def rule_summary(histograms: DataFrame) -> DataFrame:
    """Mean, standard deviation, median, interquartile range (type 7) and support of the set
    side per rank. Quantiles are exact on value and count, without the raw values."""
    quartiles = weighted_quantiles(histograms, ["rank"], "target", (0.25, 0.5, 0.75), "n_set")
    q1, median, q3 = (F.get("quantiles", F.lit(i)) for i in range(3))
    moments = side_moments(histograms).filter(F.col("side") == "set").join(quartiles, "rank")
    return moments.select("rank", "mean", F.sqrt("variance").alias("sd"), median.alias("median"), (q3 - q1).alias("iqr"), "support")


def shared_distribution(histograms: DataFrame) -> DataFrame:
    """Relative frequencies at the values both sides have, with the discrete
    divergence rounded for the annotation."""
    totals = histograms.groupBy("rank").agg(
        F.sum("n_set").alias("size_set"), F.sum("n_counter").alias("size_counter")
    )
    both = histograms.filter((F.col("n_set") > 0) & (F.col("n_counter") > 0)).join(totals, "rank")
    shared = both.select(
        "rank",
        "target",
        (F.col("n_set") / F.col("size_set")).alias("rel"),
        (F.col("n_counter") / F.col("size_counter")).alias("rel_counter_set"),
    )
    terms = F.sum(F.col("rel_counter_set") * F.log(F.col("rel_counter_set") / F.col("rel")))
    return shared.join(shared.groupBy("rank").agg(F.round(terms, 4).alias("annotation")), "rank")


def melted(distribution: DataFrame) -> DataFrame:
    """One row per (rank, value, side) for grouped bars."""
    return distribution.select("rank", "target", "rel", "rel_counter_set").unpivot(
        ["rank", "target"], ["rel", "rel_counter_set"], "variable", "value"
    )


def fitted_distribution(histograms: DataFrame, fit: str) -> DataFrame:
    """Relative frequency and fitted mass of every value of both sides, with the
    score between the fits (``expo``, ``normal``) or the mean difference
    (``mean``, no curve) rounded for the annotation."""
    moments = side_moments(histograms).select("rank", "side", "support", "mean", "variance")
    x = F.col("target").cast("double")
    if fit == "expo":
        mass = stats.exponential_mass(stats.rate(F.col("mean")), x)
    elif fit == "normal":
        mass = stats.normal_mass(F.col("mean"), F.sqrt("variance"), x)
    elif fit == "mean":
        mass = F.lit(None).cast("double")
    else:
        raise ValueError("fit must be 'expo', 'normal' or 'mean'")

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    paired = moments.groupBy("rank").agg(
        of("set", "mean").alias("mean_set"),
        of("set", "variance").alias("var_set"),
        of("counter_set", "mean").alias("mean_counter"),
        of("counter_set", "variance").alias("var_counter"),
    )
    score = {
        "expo": F.round(
            stats.exponential_divergence(stats.rate(F.col("mean_counter")), stats.rate(F.col("mean_set"))), 4
        ),
        "normal": F.round(
            stats.normal_divergence(
                F.col("mean_counter"), F.col("var_counter"), F.col("mean_set"), F.col("var_set")
            ),
            4,
        ),
        "mean": F.round(F.col("mean_set") - F.col("mean_counter"), 2),
    }[fit]
    return (
        sides(histograms)
        .join(moments, ["rank", "side"])
        .join(paired.select("rank", score.alias("annotation")), "rank")
        .select("rank", "side", "target", (F.col("n") / F.col("support")).alias("rel"), mass.alias("mass"), "annotation")
    )


def value_lists(histograms: DataFrame) -> DataFrame:
    """The raw values of both sides, one row each: ``rank, side, target``."""
    return repeat_rows(sides(histograms), "n")


def error_bars(
    split: Split, measure: str, min_supports: Sequence[float], ranks: int = 2, replicates: int = 10_000, seed: int = 42,
    tolerance: float | None = None,
) -> DataFrame:
    """Bootstrap errors of the best ``ranks`` rules at every support, whatever the
    ``measure`` that ranked them, in one plan: supports are rows of the ranking, and draws
    belong to the rule, whatever supports and ranks it has. With ``tolerance`` the errors are
    compared with their closed forms."""
    scored = score_rules(split, measure).select("set_id", "itemset", "freq", "score")
    levels = F.array(*[F.struct(F.lit(s).cast("double").alias("min_support"), F.lit(split.count_at(s)).alias("least")) for s in min_supports])
    place = F.row_number().over(Window.partitionBy("min_support").orderBy(*score_order()))
    ranked = scored.select("*", F.inline(levels)).where("freq >= least").withColumn("rank", place).where(F.col("rank") <= ranks)
    chosen = materialize(ranked.select("min_support", "rank", "set_id"), "chosen")
    # a rule that wins at several supports is drawn once
    wanted = chosen.select("set_id").distinct().withColumn("slot", F.row_number().over(Window.orderBy("set_id")).cast("bigint") - 1)
    histograms = materialize(full_histogram(split, wanted, "slot", ranks * len(min_supports)).drop("slot"), "best")
    if tolerance is None:
        errors = bootstrap_error(histograms, replicates, seed, "set_id")
    else:
        errors = checked_error(histograms, replicates, tolerance, seed=seed, key="set_id")
    return chosen.join(errors, "set_id").drop("set_id")


def target_histogram(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("target").agg(F.sum("weight").alias("n"))
