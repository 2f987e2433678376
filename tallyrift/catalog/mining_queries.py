"""Mining, splitting and the four measures."""

from __future__ import annotations

from tallyrift.catalog import bindings as b
from tallyrift.catalog import sql
from tallyrift.catalog.registry import num, query, show_rules, text
from tallyrift.operators.histogram import all_histograms
from tallyrift.operators.itemsets import frequent_itemsets
from tallyrift.plans.discovery import discover_best, discover_rules, split_population

ITEMSETS = f"SELECT {sql.text()}, freq FROM itemsets"
CELLS = f"SELECT {sql.text()}, target, n_set, n_counter FROM hist"

FLAT = sql.mined(sql.FLAT, 0.05, 5)
BASKETS = sql.mined(sql.BASKETS, 0.05, 6)
EVENTS = sql.mined(sql.EVENTS, 0.025, 3)
ORDERS = sql.mined(sql.ORDERS, 0.025, 3)


def _itemsets(transactions, min_support, miner="levels"):
    return frequent_itemsets(transactions, min_support, miner).select(text(), "freq")


@query("flat_itemsets", sql.query(FLAT, select=ITEMSETS))
def flat_itemsets(spark, folder):
    return _itemsets(b.flat_transactions(spark, folder), 0.05)


@query("basket_itemsets", sql.query(BASKETS, select=ITEMSETS))
def basket_itemsets(spark, folder):
    return _itemsets(b.baskets(spark, folder), 0.05)


@query("basket_itemsets_fpgrowth", sql.query(BASKETS, select=ITEMSETS))
def basket_itemsets_fpgrowth(spark, folder):
    return _itemsets(b.baskets(spark, folder), 0.05, "fpgrowth")


def _histogram(transactions, min_support):
    return all_histograms(split_population(transactions, min_support)).select(
        text(), "target", "n_set", "n_counter"
    )


@query("flat_histogram", sql.query(FLAT, sql.histogram(), select=CELLS))
def flat_histogram(spark, folder):
    return _histogram(b.flat_transactions(spark, folder), 0.05)


@query("basket_histogram", sql.query(BASKETS, sql.histogram(), select=CELLS))
def basket_histogram(spark, folder):
    return _histogram(b.baskets(spark, folder), 0.05)


def rules_sql(mined: str, scored: str, where: str = "TRUE", more: str = "") -> str:
    return sql.query(
        mined, sql.histogram(), scored, sql.top(where), select=f"SELECT {sql.RULE_COLUMNS}{more} FROM ranked"
    )


@query("kl_rules_flat", rules_sql(FLAT, sql.KL))
def kl_rules_flat(spark, folder):
    return show_rules(discover_rules(b.flat_transactions(spark, folder), 0.05, "kl"))


@query("kl_rules_basket", rules_sql(BASKETS, sql.KL))
def kl_rules_basket(spark, folder):
    return show_rules(discover_rules(b.baskets(spark, folder), 0.05, "kl"))


FITS = f", {sql.num('fit_set', 'fit_set')}, {sql.num('fit_counter', 'fit_counter')}"


@query("expo_rules", rules_sql(EVENTS, sql.EXPO, "fit_set <= 0.05 AND fit_counter <= 0.05", FITS))
def expo_rules(spark, folder):
    rules = discover_rules(b.event_transactions(spark, folder), 0.025, "expo", fit_threshold=0.05)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query("normal_rules", rules_sql(ORDERS, sql.NORMAL, "fit_set <= 0.18 AND fit_counter <= 0.18", FITS))
def normal_rules(spark, folder):
    rules = discover_rules(b.order_transactions(spark, folder), 0.025, "normal", fit_threshold=0.18)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query("kl_rules_orders", rules_sql(ORDERS, sql.KL))
def kl_rules_orders(spark, folder):
    return show_rules(discover_rules(b.order_transactions(spark, folder), 0.025, "kl"))


Z = f", {sql.num('z', 'z')}"


@query("mean_rules", rules_sql(BASKETS, sql.MEAN, "TRUE", Z))
def mean_rules(spark, folder):
    return show_rules(discover_rules(b.baskets(spark, folder), 0.05, "mean"), num("z"))


@query("mean_rules_significant", rules_sql(FLAT, sql.MEAN, "abs(z) > 1.96", Z))
def mean_rules_significant(spark, folder):
    rules = discover_rules(b.flat_transactions(spark, folder), 0.05, "mean", significant=True)
    return show_rules(rules, num("z"))


@query("mean_rules_orders", rules_sql(ORDERS, sql.MEAN, "TRUE", Z))
def mean_rules_orders(spark, folder):
    return show_rules(discover_rules(b.order_transactions(spark, folder), 0.025, "mean"), num("z"))


PARTS = sql.mined(
    """tx AS (SELECT l_orderkey AS tid, list(DISTINCT 'part=' || l_partkey) AS items,
  CAST(sum(l_quantity) AS BIGINT) AS target, 1 AS weight FROM lineitem GROUP BY l_orderkey)""",
    0.0005, 3,
)


@query("part_itemsets", sql.query(PARTS, select=ITEMSETS))
def part_itemsets(spark, folder):
    """Baskets of parts: thousands of items, few of them together."""
    return _itemsets(b.part_baskets(spark, folder), 0.0005)


@query("kl_rules_parts", rules_sql(PARTS, sql.KL))
def kl_rules_parts(spark, folder):
    return show_rules(discover_rules(b.part_baskets(spark, folder), 0.0005, "kl"))


@query("mean_rules_bounded", rules_sql(BASKETS, sql.MEAN))
def mean_rules_bounded(spark, folder):
    """The same rules as an exhaustive run, by branch and bound."""
    return show_rules(discover_best(b.baskets(spark, folder), 0.05, "mean")[0])


@query("expo_rules_bounded", rules_sql(EVENTS, sql.EXPO))
def expo_rules_bounded(spark, folder):
    return show_rules(discover_best(b.event_transactions(spark, folder), 0.025, "expo")[0])
