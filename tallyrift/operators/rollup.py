"""Rules with shortened codes, for all depths and supports at once.

A code at a depth is a prefix of the code at every greater depth, so the shortened itemsets
form a hierarchy: the counts are added up once, at the greatest depth, and every smaller depth
adds up those sums. A rule of some support belongs to all lower ones, so one ``level`` per rule,
the number of supports it reaches, stands for all of them. Depths and supports are
columns: more of them add rows, no branches and no jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.functions.text import shorten_itemset
from tallyrift.operators.histogram import Split
from tallyrift.operators.ranking import number_rows, score_order
from tallyrift.session import materialize


@dataclass(frozen=True)
class RolledRules:
    rules: DataFrame  # depth, min_support, node, itemset, score
    values: DataFrame  # depth, min_support, node, target, n


def roll_up_all(split: Split, scored: DataFrame, min_supports: Sequence[float], depths: Sequence[int]) -> RolledRules:
    """The rules of the stored table ``scored`` (``set_id, itemset, freq, score``) with codes
    shortened to each of ``depths``, at each of ``min_supports``. Rules that become equal add up
    their values and keep the score of the first of them at that support. A ``node`` names
    a shortened itemset within its depth, at all supports. Settings may repeat; they count once.
    Negative depths are depth 0. No supports or depths end the job."""
    supports, levels = sorted({float(s) for s in min_supports}), sorted({max(d, 0) for d in depths})
    if not supports or not levels:
        raise ValueError("give at least one support and one depth")
    least = [split.count_at(support) for support in supports]
    level = sum((F.when(F.col("freq") >= count, 1).otherwise(0) for count in least), F.lit(0))
    kept = scored.withColumn("level", level).filter(F.col("level") > 0)
    numbered = number_rows(kept, score_order(), "position", kept.count())
    numbered = materialize(
        numbered.select("set_id", shorten_itemset("itemset", levels[-1]).alias("itemset"), "score", "level", "position"), "numbered"
    )
    bottoms = materialize(numbered.groupBy("itemset").agg(F.min("position").alias("bottom")), "bottoms")
    steps = [F.struct(F.lit(d).alias("depth"), shorten_itemset("itemset", d).alias("itemset")) for d in levels]
    steps = bottoms.select("bottom", F.explode(F.array(*steps)).alias("step")).select("bottom", "step.depth", "step.itemset")
    nodes = steps.groupBy("depth", "itemset").agg(F.min("bottom").alias("node"))
    ladder = materialize(steps.join(nodes, ["depth", "itemset"]), "ladder")

    members = numbered.join(bottoms, "itemset")
    reached = F.explode(F.slice(F.array(*[F.lit(s) for s in supports]), F.lit(1), F.col("level"))).alias("min_support")
    best = members.groupBy("bottom", "level").agg(F.min(F.struct("position", "score")).alias("first"))
    heads = best.join(ladder, "bottom").select("depth", "node", "itemset", "first", reached)
    rules = heads.groupBy("depth", "min_support", "node", "itemset").agg(F.min("first").alias("first"))

    counted = split.cells.join(members.select("set_id", "bottom", "level"), "set_id")
    sums = counted.groupBy("bottom", "level", "target").agg(F.sum("n_set").alias("n"))
    climbed = sums.join(ladder.select("bottom", "depth", "node"), "bottom").select("depth", "node", "target", "n", reached)
    values = climbed.groupBy("depth", "min_support", "node", "target").agg(F.sum("n").alias("n"))
    return RolledRules(
        materialize(rules.select("depth", "min_support", "node", "itemset", "first.score"), "rolled"), materialize(values, "rolled-values")
    )
