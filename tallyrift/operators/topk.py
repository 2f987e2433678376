"""The best rules without scoring all itemsets: branch and bound.

Every itemset that is counted comes with its target histogram, from which follows how far any
subset of its transactions, at least the least support of them, could push the score: the
best subset takes the highest (or lowest) targets. An itemset whose bound lies below the k-th
best score so far is not extended, since all larger itemsets hold subsets of its
transactions. The k-th best score passes on from size to size.

Only scores that follow from the two means have such a bound: ``mean`` and ``expo``. The
discrete divergence has none that prunes: a subset may take one transaction of every value
and all of one rare value, whose divergence is nearly unlimited."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.operators import itemsets
from tallyrift.operators.histogram import Split, split_cells
from tallyrift.operators.itemsets import IDS, Encoded, held_by
from tallyrift.session import local_table, materialize

BINS = 1024  # classes of target values that bounds are taken from
SLACK = 1e-9  # scores this close count as equal while sets are left out
MEASURES = ("mean", "expo")


def _class_of(target: Column, low: float, high: float) -> Column:
    """One of BINS classes of equal width; the width changes how tight bounds are, not their truth."""
    return F.floor((target - F.lit(low)) * (BINS / max(high - low, 1.0)))


def _reach(cells: DataFrame, n: int, total: float, least: int, high: bool) -> DataFrame:
    """``at, mean, counter``: the furthest mean of any ``least`` or more transactions of a set
    and the furthest mean of the others, upwards (``high``) or downwards. ``cells`` has ``at,
    bin, n, s, low, top``: classes of targets, at most BINS + 1 a set."""
    edge, best = (F.col("top"), F.max) if high else (F.col("low"), F.min)
    order = Window.partitionBy("at").orderBy(F.desc("bin") if high else F.col("bin"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    run = cells.withColumns(
        {"_n": F.coalesce(F.sum("n").over(before), F.lit(0)), "_s": F.coalesce(F.sum("s").over(before), F.lit(0.0)), "_edge": edge}
    )
    first, last = F.greatest(F.col("_n"), F.lit(least)), F.least(F.col("_n") + F.col("n"), F.lit(n - 1))
    run = run.withColumns({"_first": first, "_last": last}).where("_first <= _last")

    def taken(size: str) -> Column:  # no subset of this size has a sum further out
        return F.col("_s") + (F.col(size) - F.col("_n")) * F.col("_edge")

    def means(size: str) -> Column:
        return taken(size) / F.col(size)

    def counters(size: str) -> Column:
        return (F.lit(total) - taken(size)) / (F.lit(n) - F.col(size))

    # both means change one way inside a class, so its ends bound them
    out, back = (F.greatest, F.least) if high else (F.least, F.greatest)
    other = F.min if high else F.max
    return run.groupBy("at").agg(
        best(out(means("_first"), means("_last"))).alias("mean"), other(back(counters("_first"), counters("_last"))).alias("counter")
    )


def _expo(ratio: Column) -> Column:
    """The exponential score from mean inside over mean outside; least at 1, rising both ways."""
    return F.log(ratio) + 1 / ratio - 1


def _scored(counted: DataFrame, encoded: Encoded, measure: str, total: float, low: float, high: float) -> DataFrame:
    """``at, freq, score, bound`` of every frequent set in ``counted`` (``at, target, n``)."""
    x = F.col("target").cast("double")
    cells = counted.groupBy("at", _class_of(x, low, high).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum(x * F.col("n")).alias("s"), F.min(x).alias("low"), F.max(x).alias("top")
    )
    cells = materialize(cells, "classes")
    sums = cells.groupBy("at").agg(F.sum("n").alias("freq"), F.sum("s").alias("s")).where(F.col("freq") >= encoded.min_count)
    least, n = max(encoded.min_count, 1), encoded.n
    mean, counter = F.col("s") / F.col("freq"), (F.lit(total) - F.col("s")) / F.nullif(F.lit(n) - F.col("freq"), F.lit(0))
    up = _reach(cells, n, total, least, True).withColumnsRenamed({"mean": "up", "counter": "up_counter"})
    if measure == "mean":
        found = sums.join(up, "at", "left")
        score, bound = mean - counter, F.col("up") - F.col("up_counter")
    else:
        down = _reach(cells, n, total, least, False).withColumnsRenamed({"mean": "down", "counter": "down_counter"})
        found = sums.join(up, "at", "left").join(down, "at", "left")
        proper = (mean > 0) & (counter > 0)
        score = F.when(proper, _expo(mean / F.when(proper, counter)))
        inside = (F.col("down") > 0) & (F.col("up_counter") > 0)  # elsewhere nothing bounds the ratio
        sides = F.greatest(
            _expo(F.greatest(F.col("up") / F.col("up_counter"), F.lit(1.0))), _expo(F.least(F.col("down") / F.col("down_counter"), F.lit(1.0)))
        )
        bound = F.when(inside, sides).otherwise(F.lit(math.inf))
    # no bound: everybody holds the set, larger sets may compare something
    return found.select("at", "freq", score.alias("score"), F.coalesce(bound, F.lit(math.inf)).alias("bound"))


def _population(encoded: Encoded) -> tuple[float, float, float]:
    """Sum, least and largest of all targets."""
    x = F.col("target").cast("double")
    row = encoded.totals.agg(F.sum(x * F.col("n_tot")), F.min(x), F.max(x)).first()
    return tuple(v or 0.0 for v in row)


def best_split(encoded: Encoded, measure: str = "mean", k: int = 10) -> tuple[Split, list[dict[str, int]]]:
    """A split that holds the ``k`` best rules of ``measure`` (and sets that score alike), and
    for each size how many sets were ``counted``, were ``frequent`` and were ``extended``."""
    if measure not in MEASURES:
        raise ValueError(f"only {MEASURES} have a bound")
    spark, n = encoded.rows.sparkSession, encoded.n
    population = _population(encoded)
    level = encoded.items.select(F.array("id").alias("ids"))
    local: list[tuple[int, ...]] | None = [(i,) for i in range(encoded.width)] if encoded.width <= itemsets.LOCAL_SETS else None
    size, count, best, visited = 1, encoded.width, [], []
    while count:
        if local is not None:
            wanted = local_table(spark, {"at": list(range(count)), "ids": [list(i) for i in local]}, {"at": pa.int64(), **IDS})
        else:
            wanted = materialize(level.select("ids").withColumn("at", F.monotonically_increasing_id()), "wanted")
        rows = encoded.rows.filter(F.size("ids") >= size)
        scored = _scored(held_by(rows, wanted, count, by_target=True), encoded, measure, *population)
        scored = materialize(scored.join(wanted, "at"), "scored")
        top = scored.where(F.col("score").isNotNull()).orderBy(F.desc("score")).limit(k).select("score").collect()
        best = sorted((*best, *(r.score for r in top)), reverse=True)[:k]
        least = best[-1] - SLACK if len(best) == k else -math.inf
        kept = materialize(scored.where(F.col("bound") >= least).select("ids"), "open")
        going = kept.count()
        visited.append({"size": size, "counted": count, "frequent": scored.count(), "extended": going})
        found = scored.where(F.col("score") >= least).select("ids", "freq", "score")
        winners = found if size == 1 else winners.where(F.col("score") >= least).unionByName(found)
        size += 1
        if going < size:
            break
        local = [tuple(r.ids) for r in kept.collect()] if going <= itemsets.LOCAL_SETS else None
        listed = None if local is None else itemsets._ahead(local, itemsets.LOCAL_SETS, 1)
        if listed is not None:
            local, count = listed, len(listed)
            continue
        local = None
        if size == 2:  # pairs that transactions hold, of two open items
            level = itemsets._pairs(encoded.rows, encoded.width).filter(F.col("freq") >= encoded.min_count)
            for at in (0, 1):
                level = level.join(kept.select(F.get("ids", F.lit(0)).alias("one")), F.get("ids", F.lit(at)) == F.col("one"), "left_semi")
        else:
            level = itemsets._extend(kept, size)
        level = materialize(level.select("ids"), "candidates")
        count = level.count()
    if not visited:
        winners = encoded.items.select(F.array("id").alias("ids"), "freq").limit(0)
    chosen, number = _named(encoded, winners)
    return split_cells(encoded, chosen, number), visited


def _named(encoded: Encoded, winners: DataFrame) -> tuple[DataFrame, int]:
    """``set_id, itemset, ids, freq`` of the few sets that are left."""
    kept = materialize(winners.select("ids", "freq").withColumn("set_id", F.monotonically_increasing_id()), "winners")
    named = kept.select("set_id", "ids", "freq", F.explode("ids").alias("id")).join(encoded.items.select("id", "item"), "id")
    named = named.groupBy("set_id", "ids", "freq").agg(F.array_sort(F.collect_list("item")).alias("itemset"))
    named = materialize(named.select("set_id", "itemset", "ids", "freq"), "named")
    return named, named.count()
