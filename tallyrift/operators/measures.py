"""Interestingness measures: set against counter-set, one row per itemset.

Every sum over the counter side is (sum over the population) - (change at the
values that occur inside the itemset), so the measures read only ``cells`` and
a one-row summary of ``totals``. The normal fit also walks from each value to the next one;
it does so inside ranges of values, which hand on what they end with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyrift.functions import stats
from tallyrift.operators.histogram import Split
from tallyrift.operators.ranking import number_rows
from tallyrift.session import materialize


RANGE_VALUES = 1 << 16  # distinct target values that are walked in one task


def summarise(split: Split) -> DataFrame:
    """Sizes, means, population variances, entropies and the discrete divergence
    of both sides in one aggregation over the cells.

    Moments are taken around the population mean, which keeps the subtraction
    accurate for targets far from 0."""
    n = split.n
    x, n_tot = F.col("target"), F.col("n_tot").cast("double")
    mean = split.totals.agg(F.round(F.sum(x * n_tot) / F.sum("n_tot")).cast("bigint").alias("mean"))
    centre = mean.scalar()
    whole = split.totals.agg(
        F.struct(
            F.sum((x - centre) * n_tot).alias("s1"),
            F.sum((x - centre) * (x - centre) * n_tot).alias("s2"),
            F.sum(stats.x_log_x(F.col("n_tot"))).alias("logs"),
        ).alias("whole")
    ).scalar()
    x = (F.col("target") - centre).cast("double")
    inside, outside = F.col("n_set"), F.col("n_counter")
    both = inside + outside
    sums = split.cells.groupBy("set_id").agg(
        F.sum(x * inside).alias("s1"),
        F.sum(x * x * inside).alias("s2"),
        F.sum(stats.x_log_x(inside)).alias("logs"),
        F.sum(stats.x_log_x(outside) - stats.x_log_x(both)).alias("logs_change"),
        F.sum(F.when(outside > 0, outside)).alias("shared_counter"),
        F.sum(F.when(outside > 0, outside * F.log(outside / inside))).alias("weighted_logs"),
    )
    freq = F.col("freq").cast("double")
    rest = F.nullif(F.lit(n) - F.col("freq"), F.lit(0)).cast("double")  # null: nobody outside
    mean_set, mean_counter = F.col("s1") / freq, (whole["s1"] - F.col("s1")) / rest
    variance_set = F.col("s2") / freq - mean_set * mean_set
    variance_counter = (whole["s2"] - F.col("s2")) / rest - mean_counter * mean_counter
    # sum of p ln(p / q) with p = n_counter / rest and q = n_set / freq
    divergence = (F.col("weighted_logs") + F.col("shared_counter") * F.log(freq / rest)) / rest
    return split.itemsets.join(sums, "set_id").select(
        "set_id",
        "itemset",
        "freq",
        (F.lit(n) - F.col("freq")).alias("n_counter"),
        (mean_set + centre).alias("mean"),
        (mean_counter + centre).alias("mean_counter"),
        F.greatest(variance_set, F.lit(0.0)).alias("var_set"),
        F.when(rest.isNotNull(), F.greatest(variance_counter, F.lit(0.0))).alias("var_counter"),
        (F.col("logs") / freq - F.log(freq)).alias("p_log_p_set"),
        ((whole["logs"] + F.col("logs_change")) / rest - F.log(rest)).alias("p_log_p_counter"),
        F.when(rest.isNotNull(), F.coalesce(divergence, F.lit(0.0))).alias("divergence"),
    )


HEAD = ["set_id", "itemset", "freq", "n_counter", "mean"]


def discrete_divergence(split: Split) -> DataFrame:
    """Discrete KL divergence, counter-set against set, over shared values only
    and unsmoothed: 0 for disjoint sides, possibly negative."""
    return summarise(split).select(*HEAD, F.col("divergence").alias("score"))


def mean_difference(split: Split) -> DataFrame:
    """Mean inside minus mean outside, with Welch's z (population variances)."""
    error = F.sqrt(F.col("var_set") / F.col("freq") + F.col("var_counter") / F.nullif("n_counter", F.lit(0)))
    gap = F.col("mean") - F.col("mean_counter")
    return summarise(split).select(
        *HEAD, "mean_counter", "var_set", "var_counter",
        F.try_divide(gap, error).alias("z"), gap.alias("score"),
    )


def _exponential_fit(p_log_p: Column, rate: Column) -> Column:
    """sum of p (ln p - ln rate + rate / 2 (2x + 1)); the terms without ln p add
    up because the p sum to 1 and rate times mean is 1."""
    return p_log_p - F.log(rate) + 1.0 + rate / 2.0


def exponential_divergence(split: Split) -> DataFrame:
    """Divergence between the exponential fits of both sides, with the divergence
    of each side from its own fit."""
    rated = summarise(split).select(
        *HEAD, "p_log_p_set", "p_log_p_counter",
        stats.rate(F.col("mean")).alias("rate_set"),
        stats.rate(F.col("mean_counter")).alias("rate_counter"),
    )
    return rated.select(
        *HEAD, "rate_set", "rate_counter",
        _exponential_fit(F.col("p_log_p_set"), F.col("rate_set")).alias("fit_set"),
        _exponential_fit(F.col("p_log_p_counter"), F.col("rate_counter")).alias("fit_counter"),
        stats.exponential_divergence(F.col("rate_counter"), F.col("rate_set")).alias("score"),
    )


def _steps(n: Column, edge: Column, x: Column) -> list[Column]:
    """``n`` times the differences of the first three powers of ``edge`` and ``x``; 0 without an edge."""
    return [F.coalesce(n * (F.pow(edge, F.lit(k)) - F.pow(x, F.lit(k))), F.lit(0.0)) for k in (1, 2, 3)]


STEPS = ("b1", "b2", "b3")


def _line(split: Split, centre: float) -> DataFrame:
    """The population's values in order: ``j, target, x`` (around ``centre``), ``n_tot``, the
    next value ``edge``, and value and count before."""
    totals = materialize(split.totals.select("target", "n_tot"), "values")
    placed = materialize(number_rows(totals, [F.col("target")], "j"), "placed")
    x = (F.col("target") - F.lit(centre)).cast("double")
    after = placed.select((F.col("j") - 1).alias("j"), x.alias("edge"))
    before = placed.select((F.col("j") + 1).alias("j"), x.alias("x_before"), F.col("n_tot").alias("n_before"))
    joined = placed.withColumn("x", x).join(after, "j", "left").join(before, "j", "left")
    return materialize(joined, "line")


def _inside_sums(cells: DataFrame) -> DataFrame:
    """Per itemset the sums over its values but the last one: ``n_excl, logs, b1, b2, b3``. A
    value's edge is the next one; ranges of values are walked apart and hand on their first."""
    part = Window.partitionBy("set_id", "range")
    edged = cells.withColumns({"edge_set": F.lead("x").over(part.orderBy("j")), "last": F.col("j") == F.max("j").over(part)})
    n = F.col("n_set").cast("double")
    inner = F.when(F.col("edge_set").isNotNull(), n)
    ranges = edged.groupBy("set_id", "range").agg(
        F.min("x").alias("x_first"), F.max("x").alias("x_last"), F.max(F.when(F.col("last"), n)).alias("n_last"),
        F.coalesce(F.sum(inner), F.lit(0.0)).alias("n_excl"), F.coalesce(F.sum(F.when(inner.isNotNull(), stats.x_log_x(n))), F.lit(0.0)).alias("logs"),
        *(F.sum(c).alias(b) for b, c in zip(STEPS, _steps(n, F.col("edge_set"), F.col("x")))),
    )
    onward = F.lead("x_first").over(Window.partitionBy("set_id").orderBy("range"))  # one row per range
    carried = ranges.withColumn("onward", onward)
    more = F.when(F.col("onward").isNotNull(), F.col("n_last"))
    sums = [F.coalesce(more, F.lit(0.0)) + F.col("n_excl"), F.coalesce(stats.x_log_x(more), F.lit(0.0)) + F.col("logs")]
    sums += [F.col(b) + c for b, c in zip(STEPS, _steps(F.col("n_last"), F.col("onward"), F.col("x_last")))]
    return carried.groupBy("set_id").agg(*(F.sum(c).alias(name) for name, c in zip(("n_excl", "logs", *STEPS), sums)))


def _outside_sums(cells: DataFrame, line: DataFrame) -> DataFrame:
    """The same sums for the counter side, as the population's minus the change at the cells.

    Where a value vanishes (all its transactions are inside) the value before reaches over it:
    each vanished value adds its step, times the count of the last value that is left before.
    Runs of vanished values are followed inside ranges; a range hands on what it ends with."""
    ends = line.groupBy("range").agg(F.max("j").alias("end"), F.max_by("n_tot", "j").alias("n_end"), F.max_by("x", "j").alias("x_end"))
    ends = ends.select("range", "end", F.struct(F.col("n_end").cast("double").alias("n"), F.col("x_end").alias("x")).alias("tail"))
    part = Window.partitionBy("set_id", "range").orderBy("j")
    left, gone = F.col("n_counter").cast("double"), F.col("n_counter") == 0
    joined = F.lag("j").over(part) == F.col("j") - 1
    before = F.when(joined, F.struct(F.lag(left).over(part).alias("n"), F.lag("x").over(part).alias("x"))).otherwise(
        F.struct(F.col("n_before").cast("double").alias("n"), F.col("x_before").alias("x"))
    )
    opens = gone & ~F.coalesce(joined & (F.lag("n_counter").over(part) == 0), F.lit(False))
    head = opens & (F.col("j") == F.col("range") * F.lit(RANGE_VALUES)) & (F.col("j") > 0)  # what is before lies in another range
    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("double").alias("x"))
    start = F.when(opens & ~head, F.when(F.col("j") == 0, nothing).otherwise(before))
    marked = cells.withColumns({"gone": gone, "start": start})
    run = F.last("start", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("run", run)
    marked = marked.join(F.broadcast(ends.select("range", "end")), "range")  # a row for RANGE_VALUES values
    known = F.when(F.col("gone"), F.col("run.n"))
    unknown = F.when(F.col("gone") & F.col("run").isNull(), F.lit(1.0))
    x, edge, inside = F.col("x"), F.col("edge"), F.col("n_set").cast("double")
    at_end = F.col("j") == F.col("end")
    tail = F.when(F.col("gone"), F.col("run")).otherwise(F.struct(left.alias("n"), x.alias("x")))
    logs = stats.x_log_x(left) - stats.x_log_x(F.col("n_tot").cast("double"))
    ranges = marked.groupBy("set_id", "range").agg(
        F.sum(inside).alias("inside"), F.sum(F.when(left > 0, logs).otherwise(-stats.x_log_x(F.col("n_tot").cast("double")))).alias("logs"),
        *(F.sum(a - b).alias(name) for name, a, b in zip(STEPS, _steps(F.coalesce(known, F.lit(0.0)), edge, x), _steps(inside, edge, x))),
        *(F.sum(c).alias(f"h{name}") for name, c in zip(STEPS, _steps(F.coalesce(unknown, F.lit(0.0)), edge, x))),
        F.max(unknown).alias("waits"), F.max(F.when(at_end, F.lit(True))).alias("ended"),
        F.max(F.when(at_end, tail)).alias("own"), F.max(F.when(at_end, F.col("gone"))).alias("end_gone"),
    )
    ranges = ranges.join(F.broadcast(ends), "range")
    order = Window.partitionBy("set_id").orderBy("range")  # one row per range
    outgoing = F.when(F.col("ended"), F.col("own")).otherwise(F.col("tail"))  # null: a run through the whole range
    previous = F.broadcast(ends.select((F.col("range") + 1).alias("range"), F.col("tail").alias("other")))
    ranges = ranges.withColumn("out", outgoing).join(previous, "range", "left").withColumn("follows", F.lag("range").over(order) == F.col("range") - 1)
    ranges = ranges.withColumn("out", F.when(F.col("out").isNull() & ~F.coalesce("follows", F.lit(False)), F.coalesce("other", nothing)).otherwise(F.col("out")))
    passed = F.last("out", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.withColumn("into", F.when(F.coalesce("follows", F.lit(False)), passed).otherwise(F.coalesce("other", nothing)))
    ranges = ranges.withColumn("final", F.coalesce("out", "into"))
    return ranges.groupBy("set_id").agg(
        F.sum("inside").alias("inside"), F.sum("logs").alias("logs"),
        *(F.sum(F.col(b) + F.coalesce(F.when(F.col("waits").isNotNull(), F.col("into.n") * F.col(f"h{b}")), F.lit(0.0))).alias(b) for b in STEPS),
        F.max_by("final", "range").alias("final"), F.max("range").alias("range"), F.max_by("ended", "range").alias("ended"),
        F.max_by("end_gone", "range").alias("end_gone"),
    )


def normal_fits(split: Split) -> DataFrame:
    """``set_id`` with mean, sample variance and divergence from the normal fit of both sides.
    A value reaches up to the next value that occurs; the last one has no edge and is left
    out. No histogram of all values is made, and no itemset's values meet in one task beyond
    RANGE_VALUES."""
    summary = summarise(split)
    centre = split.totals.agg(F.round(F.sum(F.col("target") * F.col("n_tot").cast("double")) / F.sum("n_tot"))).first()[0] or 0.0
    line = _line(split, centre).withColumn("range", F.floor(F.col("j") / F.lit(RANGE_VALUES)))
    n_tot = F.col("n_tot").cast("double")
    whole = line.agg(
        F.sum(stats.x_log_x(n_tot)), F.max("x"), F.max("range"), F.max_by("n_tot", "j"),
        *(F.sum(c) for c in _steps(n_tot, F.col("edge"), F.col("x"))),
    ).first()
    whole = [v or 0.0 for v in whole]
    cells = split.cells.join(line, "target")
    cells = materialize(cells.select("set_id", "range", "j", "x", "n_set", "n_counter", "n_tot", "edge", "x_before", "n_before"), "walked")
    inside = _inside_sums(cells).withColumnsRenamed({c: f"in_{c}" for c in ("n_excl", "logs", *STEPS)})
    outside = _outside_sums(cells, line)
    # what the counter side ends with: the last value, or the last that is left before it
    touched = (F.col("range") == F.lit(whole[2])) & F.coalesce("ended", F.lit(False))
    last = F.when(touched, F.col("final")).otherwise(F.struct(F.lit(float(whole[3])).alias("n"), F.lit(float(whole[1])).alias("x")))
    fitted = summary.join(inside, "set_id").join(outside.withColumn("last", last), "set_id")
    vanished = touched & F.coalesce("end_gone", F.lit(False))

    def sample(variance: str, size: str) -> Column:
        return F.col(variance) * F.col(size) / F.nullif(F.col(size) - 1, F.lit(0))

    def fit(size: Column, excluded: Column, logs: Column, steps: list[Column], mean: Column, variance: Column) -> Column:
        cubes = (steps[2] - 3 * mean * steps[1] + 3 * mean * mean * steps[0]) / (3.0 * F.nullif(variance, F.lit(0.0)))
        held = logs - excluded * F.log(size) - excluded * stats.log_normal_height(variance) + 0.5 * cubes
        return F.coalesce(held / size, F.lit(0.0))

    rest = F.nullif("n_counter", F.lit(0)).cast("double")
    gap = [F.pow(F.lit(float(whole[1])), F.lit(k)) - F.pow(F.col("last.x"), F.lit(k)) for k in (1, 2, 3)]
    steps = [F.lit(float(w)) + F.col(b) - F.when(vanished, F.col("last.n") * g).otherwise(0.0) for w, b, g in zip(whole[4:], STEPS, gap)]
    ended = F.when(F.col("last.n") > 0, F.col("last.n")).otherwise(F.lit(1.0))
    return fitted.select(
        "set_id", "itemset", "freq", "n_counter", "mean", "mean_counter",
        sample("var_set", "freq").alias("var_set"), sample("var_counter", "n_counter").alias("var_counter"),
        fit(F.col("freq").cast("double"), F.col("in_n_excl"), F.col("in_logs"), [F.col(f"in_{b}") for b in STEPS], F.col("mean") - centre, sample("var_set", "freq")).alias("fit_set"),
        F.when(rest.isNotNull(), fit(rest, rest - F.col("last.n"), F.lit(float(whole[0])) + F.col("logs") - stats.x_log_x(ended), steps, F.col("mean_counter") - centre, sample("var_counter", "n_counter"))).alias("fit_counter"),
    )


def normal_divergence(split: Split, fit_threshold: float | None = None, formula: str = "squared_variance") -> DataFrame:
    """Divergence between the normal fits of both sides; with a threshold, of rules whose set
    side fits."""
    kept = normal_fits(split)
    if fit_threshold is not None:
        kept = kept.filter(F.col("fit_set") <= fit_threshold)
    score = stats.normal_divergence(F.col("mean_counter"), F.col("var_counter"), F.col("mean"), F.col("var_set"), formula)
    return kept.withColumn("score", score)
