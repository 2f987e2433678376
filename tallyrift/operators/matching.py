"""Comparing rule sets mined from two databases.

A rule set is a pair of tables: ``rules(itemset, score, position)`` and
``values(itemset, target, n)``; itemsets are sorted, so equal itemsets are equal
arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.functions.text import shorten_itemset
from tallyrift.operators.histogram import Split
from tallyrift.operators.ranking import number_rows, score_order, top_percent
from tallyrift.session import materialize, plain_unions

EPSILON = 1e-10  # fixed value: added to both aligned distributions


@dataclass(frozen=True)
class RuleSet:
    rules: DataFrame
    values: DataFrame

    def restricted_to(self, rules: DataFrame) -> RuleSet:
        return RuleSet(rules, self.values.join(rules.select("itemset"), "itemset", "left_semi"))


def rule_set(split: Split, scored: DataFrame) -> RuleSet:
    """The set side of all rules of the stored table ``scored``, ``position``
    counting from the best. The rules are stored again with their position."""
    rules = number_rows(scored.select("set_id", "itemset", "score"), score_order(), "position")
    rules = materialize(rules, "rules")
    values = split.cells.join(rules.select("set_id", "itemset"), "set_id").select(
        "itemset", "target", F.col("n_set").alias("n")
    )
    return RuleSet(rules.select("itemset", "score", "position"), values)


def best_percent(rules: RuleSet, percent: float) -> RuleSet:
    return rules.restricted_to(top_percent(rules.rules, percent))


def merge(left: RuleSet, right: RuleSet) -> RuleSet:
    """All rules of both; where both have a rule, ``right`` wins."""
    plain_unions(left.rules.sparkSession)
    only_left = left.restricted_to(left.rules.join(right.rules.select("itemset"), "itemset", "left_anti"))
    return RuleSet(
        only_left.rules.unionByName(right.rules), only_left.values.unionByName(right.values)
    )


def match(left: RuleSet, right: RuleSet) -> DataFrame:
    """Rules found in both sets with the symmetrised, smoothed divergence of their
    distributions. Values are aligned by adding up both sides' counts per
    (rule, value), which takes one shuffle instead of a full outer join."""
    plain_unions(left.rules.sparkSession)
    both = left.rules.select("itemset", F.col("score").alias("left_score")).join(
        right.rules.select("itemset", F.col("score").alias("right_score")), "itemset"
    )
    zero = F.lit(0).cast("bigint")
    counts = left.values.select("itemset", "target", F.col("n").alias("l"), zero.alias("r")).unionByName(
        right.values.select("itemset", "target", zero.alias("l"), F.col("n").alias("r"))
    )
    aligned = (
        counts.join(both.select("itemset"), "itemset", "left_semi")
        .groupBy("itemset", "target")
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )
    return both.join(symmetric_divergence(aligned, ["itemset"]), "itemset")


def symmetric_divergence(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Half the sum of both smoothed divergences per ``key``; ``aligned`` has the counts
    ``l`` and ``r`` of every value of either side."""
    sizes = aligned.groupBy(*key).agg(F.sum("l").alias("size_l"), F.sum("r").alias("size_r"))
    p = F.col("l") / F.col("size_l") + EPSILON
    q = F.col("r") / F.col("size_r") + EPSILON
    forward = F.sum(F.when(F.col("l") > 0, p * F.log(p / q)))
    backward = F.sum(F.when(F.col("r") > 0, q * F.log(q / p)))
    return aligned.join(sizes, key).groupBy(*key).agg((0.5 * (forward + backward)).alias("divergence"))


def match_rate(left: RuleSet, right: RuleSet, matched: DataFrame) -> DataFrame:
    """Rule counts and the matched share of the smaller set in percent."""

    def size(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.count(F.lit(1)).alias(name))

    counts = left.rules.sparkSession.range(1).select(
        size(left.rules, "n_left").scalar().alias("n_left"),
        size(right.rules, "n_right").scalar().alias("n_right"),
        size(matched, "n_matched").scalar().alias("n_matched"),
    )
    smaller = F.least("n_left", "n_right")
    return counts.withColumn("match_rate", F.try_divide(F.col("n_matched") * 100.0, smaller))


def roll_up(rules: RuleSet, depth: int) -> RuleSet:
    """Shorten diagnosis codes; rules that become equal add up their values and
    keep the score of the first of them."""
    shorter = rules.rules.select(
        F.col("itemset").alias("long"), shorten_itemset("itemset", depth).alias("itemset"), "score", "position"
    )
    merged = shorter.groupBy("itemset").agg(
        F.min_by("score", "position").alias("score"), F.min("position").alias("position")
    )
    values = (
        rules.values.withColumn("itemset", shorten_itemset("itemset", depth))
        .groupBy("itemset", "target")
        .agg(F.sum("n").alias("n"))
    )
    return RuleSet(materialize(merged, "rolled"), values)
