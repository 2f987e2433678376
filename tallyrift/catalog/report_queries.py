"""Rule text, value lists, distribution tables, summaries and error bars."""

from __future__ import annotations

from tallyrift.catalog import bindings as b
from tallyrift.catalog import sql
from tallyrift.catalog.mining_queries import BASKETS, EVENTS, FLAT, ORDERS
from tallyrift.catalog.registry import num, query
from tallyrift.functions import stats
from tallyrift.functions.text import rule_text
from tallyrift.operators.bootstrap import bootstrap_error, checked_error
from tallyrift.operators.ranking import top_rules
from tallyrift.plans import report
from tallyrift.plans.discovery import discover_rules, score_rules, split_population


def best_histograms(transactions, min_support, measure, ranks=2, **scoring):
    split = split_population(transactions, min_support)
    return report.rule_histograms(split, top_rules(score_rules(split, measure, **scoring), ranks), ranks)


def best(mined: str, scored: str, where: str = "TRUE") -> list[str]:
    """CTEs down to ``d(rank, target, n_set, n_counter)`` of the two best rules."""
    return [
        mined, sql.histogram(), scored, sql.top(where, 2),
        "d AS (SELECT CAST(r.rank AS INTEGER) AS rank, h.target, h.n_set, h.n_counter FROM ranked r JOIN hist h ON h.s = r.s)",
    ]


LONG = """long AS (SELECT rank, 'set' AS side, target, n_set AS n FROM d WHERE n_set > 0
  UNION ALL SELECT rank, 'counter_set', target, n_counter FROM d WHERE n_counter > 0),
raw AS (SELECT rank, side, target, unnest(range(n)) AS copy FROM long),
moments AS (SELECT rank, side, count(*) AS support, avg(target) AS mean, var_samp(target) AS variance,
  quantile_cont(target, 0.5) AS median, quantile_cont(target, 0.75) - quantile_cont(target, 0.25) AS iqr
  FROM raw GROUP BY rank, side),
pairs AS (SELECT a.rank, a.mean AS ms, a.variance AS vs, c.mean AS mc, c.variance AS vc
  FROM moments a JOIN moments c ON a.rank = c.rank AND a.side = 'set' AND c.side = 'counter_set')"""


@query(
    "rule_text",
    sql.query(
        BASKETS, sql.histogram(), sql.KL, sql.top(),
        select=r"""SELECT CAST(rank AS INTEGER) AS rank,
  array_to_string(s, ' ∧ ') || ' ⇒ ' || CAST(CAST(ceil(mean) AS BIGINT) AS VARCHAR) AS rule,
  array_to_string(list_transform(s, lambda i: replace(i, ' ', '')), ' $\wedge$ ') || ' $\Rightarrow$ '
    || CAST(CAST(ceil(mean) AS BIGINT) AS VARCHAR) AS latex FROM ranked""",
    ),
)
def rule_text_query(spark, folder):
    rules = discover_rules(b.baskets(spark, folder), 0.05, "kl")
    return rules.select("rank", rule_text().alias("rule"), rule_text(style="latex").alias("latex"))


@query(
    "rule_top2_values",
    sql.query(*best(BASKETS, sql.KL), LONG, select="SELECT rank, side, target FROM raw"),
)
def rule_top2_values(spark, folder):
    return report.value_lists(best_histograms(b.baskets(spark, folder), 0.05, "kl"))


SHARED = """rel AS (SELECT rank, target, n_set, n_counter, n_set / sum(n_set) OVER w AS rel,
  n_counter / sum(n_counter) OVER w AS rel_counter_set FROM d WINDOW w AS (PARTITION BY rank)),
shared AS (SELECT rank, target, rel, rel_counter_set,
  round(sum(rel_counter_set * ln(rel_counter_set / rel)) OVER (PARTITION BY rank), 4) + 0.0 AS annotation
  FROM rel WHERE n_set > 0 AND n_counter > 0)"""


@query(
    "dist_report_kl",
    sql.query(
        *best(FLAT, sql.KL), SHARED,
        select=f"SELECT rank, target, {sql.num('rel', 'rel')}, {sql.num('rel_counter_set', 'rel_counter_set')}, "
        "annotation FROM shared",
    ),
)
def dist_report_kl(spark, folder):
    table = report.shared_distribution(best_histograms(b.flat_transactions(spark, folder), 0.05, "kl"))
    return table.select("rank", "target", num("rel"), num("rel_counter_set"), num("annotation", digits=4))


@query(
    "dist_report_melted",
    sql.query(
        *best(BASKETS, sql.KL), SHARED,
        select=f"""SELECT rank, target, 'rel' AS variable, {sql.num('rel', 'value')} FROM shared
UNION ALL SELECT rank, target, 'rel_counter_set', {sql.num('rel_counter_set', 'value')} FROM shared""",
    ),
)
def dist_report_melted(spark, folder):
    table = report.melted(
        report.shared_distribution(best_histograms(b.baskets(spark, folder), 0.05, "kl"))
    )
    return table.select("rank", "target", "variable", num("value"))


def fitted_sql(parts: list[str], mass: str, annotation: str) -> str:
    return sql.query(
        *parts, LONG,
        select=f"""SELECT l.rank, l.side, l.target, {sql.num('l.n / m.support', 'rel')}, {sql.num(mass, 'mass')},
  {annotation} + 0.0 AS annotation
FROM long l JOIN moments m ON l.rank = m.rank AND l.side = m.side JOIN pairs p ON p.rank = l.rank""",
    )


def show_fitted(table):
    return table.select("rank", "side", "target", num("rel"), num("mass"), num("annotation", digits=4))


@query(
    "dist_report_expo",
    fitted_sql(
        best(EVENTS, sql.EXPO, "fit_set <= 0.05 AND fit_counter <= 0.05"),
        "exp(-l.target / m.mean) - exp(-(l.target + 1) / m.mean)",
        "round(ln(1 / mc) - ln(1 / ms) + (1 / ms) / (1 / mc) - 1, 4)",
    ),
)
def dist_report_expo(spark, folder):
    histograms = best_histograms(b.event_transactions(spark, folder), 0.025, "expo", fit_threshold=0.05)
    return show_fitted(report.fitted_distribution(histograms, "expo"))


def _cdf_sql(z: str) -> str:
    def horner(coefficients):
        text = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            text = f"({text} * abs({z}) + CAST({c!r} AS DOUBLE))"
        return text

    body = f"exp(-({z}) * ({z}) / 2)"
    far = f"abs({z}) + 0.65"
    for step in (4, 3, 2, 1):
        far = f"abs({z}) + {step} / ({far})"
    tail = (
        f"CASE WHEN abs({z}) > {stats.TAIL_END} THEN 0.0 WHEN abs({z}) < {stats.TAIL_SWITCH} "
        f"THEN {body} * {horner(stats.TAIL_NUMERATOR)} / {horner(stats.TAIL_DENOMINATOR)} "
        f"ELSE {body} / (({far}) * {stats.ROOT_TWO_PI}) END"
    )
    return f"CASE WHEN ({z}) > 0 THEN 1 - ({tail}) ELSE {tail} END"


@query(
    "dist_report_normal",
    fitted_sql(
        best(ORDERS, sql.NORMAL, "fit_set <= 0.18 AND fit_counter <= 0.18"),
        f"({_cdf_sql('(l.target + 1 - m.mean) / sqrt(m.variance)')}) - ({_cdf_sql('(l.target - m.mean) / sqrt(m.variance)')})",
        "round(0.5 * (pow(ms - mc, 2) / pow(vs, 2) + pow(vc, 2) / pow(vs, 2) - ln(pow(vc, 2) / pow(vs, 2)) - 1), 4)",
    ),
)
def dist_report_normal(spark, folder):
    histograms = best_histograms(b.order_transactions(spark, folder), 0.025, "normal", fit_threshold=0.18)
    return show_fitted(report.fitted_distribution(histograms, "normal"))


@query(
    "dist_report_mean",
    sql.query(
        *best(BASKETS, sql.MEAN), LONG,
        select=f"""SELECT l.rank, l.side, l.target, {sql.num('l.n / m.support', 'rel')}, round(ms - mc, 2) + 0.0 AS annotation
FROM long l JOIN moments m ON l.rank = m.rank AND l.side = m.side JOIN pairs p ON p.rank = l.rank""",
    ),
)
def dist_report_mean(spark, folder):
    histograms = best_histograms(b.baskets(spark, folder), 0.05, "mean")
    return show_fitted(report.fitted_distribution(histograms, "mean")).drop("mass")


@query(
    "rule_summary",
    sql.query(
        *best(BASKETS, sql.KL), LONG,
        select=f"SELECT rank, {sql.num('mean', 'mean')}, {sql.num('sqrt(variance)', 'sd')}, "
        f"{sql.num('median', 'median')}, {sql.num('iqr', 'iqr')}, support FROM moments WHERE side = 'set'",
    ),
)
def rule_summary(spark, folder):
    table = report.rule_summary(best_histograms(b.baskets(spark, folder), 0.05, "kl"))
    return table.select("rank", num("mean"), num("sd"), num("median"), num("iqr"), "support")


@query("target_histogram", sql.query(sql.FLAT, select="SELECT target, CAST(sum(weight) AS BIGINT) AS n FROM tx GROUP BY target"))
def target_histogram(spark, folder):
    return report.target_histogram(b.flat_transactions(spark, folder))


@query("bootstrap_sweep")
def bootstrap_sweep(spark, folder):
    """Random as well: error bars over two supports and two ranks."""
    split = split_population(b.flat_transactions(spark, folder), 0.05)
    return report.error_bars(split, "mean", (0.05, 0.1))


@query("bootstrap_se")
def bootstrap_se(spark, folder):
    """Random by nature: checked against a literal resampling loop in the tests."""
    return bootstrap_error(best_histograms(b.baskets(spark, folder), 0.05, "kl"), replicates=10_000)


CLOSED_FORM = """z AS (SELECT rank, sum(n_set) AS sq, sum(n_counter) AS sp FROM d GROUP BY rank),
m AS (SELECT rank, sum(n_set * CAST(target AS DOUBLE)) / sum(n_set) AS mq, sum(n_counter * CAST(target AS DOUBLE)) / sum(n_counter) AS mp
  FROM d GROUP BY rank),
b AS (SELECT d.rank, sqrt(sum(n_set * pow(target - mq, 2)) / pow(any_value(sq), 2) + sum(n_counter * pow(target - mp, 2)) / pow(any_value(sp), 2)) AS mean_closed_form
  FROM d JOIN z ON d.rank = z.rank JOIN m ON d.rank = m.rank GROUP BY d.rank),
c AS (SELECT d.rank, n_counter / sp AS p, n_set / sq AS q, sp, sq FROM d JOIN z ON d.rank = z.rank WHERE n_set > 0 AND n_counter > 0),
e AS (SELECT rank, sqrt((sum(p * pow(ln(p / q) + 1, 2)) - pow(sum(p * (ln(p / q) + 1)), 2)) / any_value(sp)
  + (sum(q * pow(p / q, 2)) - pow(sum(p), 2)) / any_value(sq)) AS closed_form FROM c GROUP BY rank)"""
AGREES = f"{sql.num('closed_form', 'closed_form')}, TRUE AS agrees, {sql.num('mean_closed_form', 'mean_closed_form')}, TRUE AS mean_agrees FROM e JOIN b USING (rank)"


def agreeing():
    return num("closed_form"), "agrees", num("mean_closed_form"), "mean_agrees"


@query("bootstrap_agrees", sql.query(*best(BASKETS, sql.MEAN), CLOSED_FORM, select=f"SELECT rank, {AGREES}"))
def bootstrap_agrees(spark, folder):
    """The closed forms of the standard errors, and that the bootstrap is right. The
    divergence's closed form is of first order: it knows no values that a draw loses altogether,
    so the bootstrap is held to the error that resampling cells of this size gives. The mean
    difference's is exact and holds the resampling to 5 %."""
    histograms = best_histograms(b.baskets(spark, folder), 0.05, "mean")
    return checked_error(histograms, 4000, 0.25).select("rank", *agreeing())


@query(
    "bootstrap_sweep_agrees",
    " UNION ALL ".join(
        f"SELECT * FROM ({sql.query(*best(sql.mined(sql.BASKETS, support, 6), sql.MEAN), CLOSED_FORM, select=f'SELECT {support} + 0.0 AS min_support, rank, {AGREES}')}) q{i}"
        for i, support in enumerate((0.05, 0.1))
    ),
)
def bootstrap_sweep_agrees(spark, folder):
    split = split_population(b.baskets(spark, folder), 0.05)
    bars = report.error_bars(split, "mean", (0.05, 0.1), replicates=4000, tolerance=0.25)
    return bars.select("min_support", "rank", *agreeing())
