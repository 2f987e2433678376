"""Rule matching between two databases over support and share thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.operators.histogram import Split
from tallyrift.operators.matching import RuleSet, rule_set, symmetric_divergence
from tallyrift.operators.ranking import number_within, score_order
from tallyrift.operators.rollup import roll_up_all
from tallyrift.plans.discovery import score_rules
from tallyrift.session import materialize, plain_unions


def score_all(split: Split, measure: str = "kl", **scoring) -> DataFrame:
    """The stored scores of all itemsets of ``split``."""
    scored = score_rules(split, measure, **scoring)
    return materialize(scored.select("set_id", "itemset", "freq", "score"), "scored")


def rules_at(split: Split, min_support: float, scored: DataFrame | None = None) -> RuleSet:
    """All rules at ``min_support``, which must not be below the support the split
    was mined with. A score does not depend on the support threshold, so one
    mining run and one table of scores serve a whole sweep."""
    scored = score_all(split) if scored is None else scored
    least = split.count_at(min_support)
    return rule_set(split, scored.filter(F.col("freq") >= least))


def _ranked(split: Split, min_supports: Sequence[float]) -> DataFrame:
    """All rules of every support with their position and how many there are:
    ``min_support, itemset, set_id, score, position, size``."""
    supports = sorted({float(s) for s in min_supports})
    reached = [F.when(F.col("freq") >= split.count_at(s), F.lit(s)) for s in supports]
    rules = score_all(split).withColumn("min_support", F.explode(F.array_compact(F.array(*reached)))).drop("freq")
    return materialize(number_within(materialize(rules, "reached"), ["min_support"], score_order(), "position"), "ranked")


def _best(ranked: DataFrame, percents: Sequence[float]) -> DataFrame:
    """The best share of every support, once per percent."""
    each = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    return each.filter(F.col("position") < F.floor(F.col("size") * (F.col("percent") / 100.0)))


def _sides(
    left: DataFrame, rights: Sequence[DataFrame], setting: Sequence[str], ident: str, percents: Sequence[float]
) -> tuple[DataFrame, DataFrame]:
    """The best shares of the ranked rules of both sides in every setting; the right sides
    merged, later ones winning."""
    plain_unions(left.sparkSession)
    key = [*setting, "percent", "itemset"]
    several = [_best(r, percents).withColumn("origin", F.lit(i)) for i, r in enumerate(rights)]
    last = F.max_by(F.struct("origin", ident, "score"), "origin").alias("last")
    right = reduce(DataFrame.unionByName, several).groupBy(*key).agg(last)
    right = right.select(*key, "last.origin", F.col(f"last.{ident}").alias("right_id"), F.col("last.score").alias("right_score"))
    return _best(left, percents).select(*key, F.col(ident).alias("left_id"), F.col("score").alias("left_score")), right


def _divergences(pairs: DataFrame, left: DataFrame, rights: Sequence[DataFrame], given: Sequence[str], ident: str) -> DataFrame:
    """The divergence of every pair ``given.., left_id, origin, right_id`` from the counts
    ``given.., ident, target, n`` of either side."""
    zero = F.lit(0).cast("bigint")
    mine = left.select(*given, F.col(ident).alias("left_id"), "target", F.col("n").alias("l"), zero.alias("r"))
    theirs = [
        r.select(*given, F.lit(i).alias("origin"), F.col(ident).alias("right_id"), "target", zero.alias("l"), F.col("n").alias("r"))
        for i, r in enumerate(rights)
    ]
    counts = pairs.join(mine, [*given, "left_id"]).unionByName(
        pairs.join(reduce(DataFrame.unionByName, theirs), [*given, "origin", "right_id"])
    )
    aligned = counts.groupBy(*pairs.columns, "target").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return symmetric_divergence(aligned, pairs.columns)


def _sweep_rules(
    left: Split, rights: Sequence[Split], min_supports: Sequence[float], percents: Sequence[float]
) -> tuple[DataFrame, DataFrame]:
    """The rules of both sides in every setting."""
    return _sides(_ranked(left, min_supports), [_ranked(r, min_supports) for r in rights], ["min_support"], "set_id", percents)


def match_sweep(
    left: Split,
    rights: Sequence[Split],
    min_supports: Sequence[float],
    percents: Sequence[float],
    depth: int | None = None,
) -> DataFrame:
    """Matched rules for every (min_support, percent). The rule sets of ``rights``
    are cut to their best share each and merged, later ones winning. With
    ``depth`` the codes are shortened first, so related codes match.

    All settings are matched in one plan: supports only add rows to the ranked rules,
    percents cut them, and the divergence of two rules, which no setting changes, is
    computed once per pair. Shortened codes: see ``rolled_sweep``."""
    if depth is not None:
        return rolled_sweep(left, rights, min_supports, percents, [depth]).drop("depth")
    first, second = _sweep_rules(left, rights, min_supports, percents)
    both = materialize(first.join(second, ["min_support", "percent", "itemset"]), "matched")
    pair = ["left_id", "origin", "right_id"]
    mine, *theirs = (s.cells.select("set_id", "target", F.col("n_set").alias("n")) for s in (left, *rights))
    divergence = _divergences(both.select(*pair).distinct(), mine, theirs, [], "set_id")
    return both.join(divergence, pair).select("min_support", "percent", "itemset", "left_score", "right_score", "divergence")


def rolled_sweep(
    left: Split, rights: Sequence[Split], min_supports: Sequence[float], percents: Sequence[float], depths: Sequence[int]
) -> DataFrame:
    """Matched rules for every (depth, min_support, percent), codes shortened to each depth.
    One plan for all settings, see ``operators/rollup.py``; shortened rules add up other rules at
    every support, so a divergence is computed once per pair, depth and support."""
    given = ["depth", "min_support"]
    rolled = [roll_up_all(split, score_all(split), min_supports, depths) for split in (left, *rights)]
    ranked = [materialize(number_within(r.rules, given, score_order(), "position"), "ranked") for r in rolled]
    first, second = _sides(ranked[0], ranked[1:], given, "node", percents)
    both = materialize(first.join(second, [*given, "percent", "itemset"]), "matched")
    pair = [*given, "left_id", "origin", "right_id"]
    divergence = _divergences(both.select(*pair).distinct(), rolled[0].values, [r.values for r in rolled[1:]], given, "node")
    return both.join(divergence, pair).select(*given, "percent", "itemset", "left_score", "right_score", "divergence")


def sweep_rates(
    left: Split, rights: Sequence[Split], min_supports: Sequence[float], percents: Sequence[float]
) -> DataFrame:
    """Rule counts of both sides and the matched share of the smaller one in percent, for
    every setting in which both sides have rules."""
    setting = ["min_support", "percent"]
    first, second = _sweep_rules(left, rights, min_supports, percents)
    one = F.count(F.lit(1))
    matched = first.join(second, [*setting, "itemset"]).groupBy(*setting).agg(one.alias("n_matched"))
    sizes = first.groupBy(*setting).agg(one.alias("n_left")).join(second.groupBy(*setting).agg(one.alias("n_right")), setting)
    return sizes.join(matched, setting, "left").select(
        *setting, "n_left", "n_right", F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        (F.coalesce("n_matched", F.lit(0)) * 100.0 / F.least("n_left", "n_right")).alias("match_rate"),
    )


def sweep_summary(matched: DataFrame) -> DataFrame:
    """Mean and population deviation of the divergences per setting."""
    setting = [c for c in ("depth", "min_support", "percent") if c in matched.columns]
    return matched.groupBy(*setting).agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.avg("divergence").alias("mean"),
        F.stddev_pop("divergence").alias("sd"),
    )
