import random
from collections import Counter
from itertools import combinations

import literal
import pytest
from pyspark.sql import functions as F

from tallyrift.operators import histogram, itemsets, ranking
from tallyrift.operators.transactions import from_columns, from_facts, keep_marked_items
from tallyrift.plans.discovery import split_population

DRAW = random.Random(11)
# "hot" is in most rows, the others get rarer
ROWS = [
    ([i for i, p in (("hot", 0.9), ("a", 0.5), ("b", 0.4), ("c", 0.3), ("d", 0.3), ("e", 0.05)) if DRAW.random() < p],
     DRAW.randint(0, 5))
    for _ in range(400)
]


def mined(table):
    return {tuple(row.itemset): row.freq for row in table.collect()}


@pytest.mark.parametrize("support", [0.02, 0.1, 0.5])
def test_level_wise_equals_fp_growth_equals_definition(transactions, support):
    wanted = literal.itemsets(ROWS, support)
    assert mined(itemsets.frequent_itemsets(transactions(ROWS), support)) == wanted
    assert mined(itemsets.frequent_itemsets(transactions(ROWS), support, "fpgrowth")) == wanted


LIMITS = {
    "joined candidates": {"LOCAL_SETS": 0},
    "few listed candidates": {"LOCAL_SETS": 12},
    "a tree per itemset": {"LOCAL_SETS": 0, "TREE_SETS": 1},
    "several trees": {"LOCAL_SETS": 3, "TREE_SETS": 4, "TREE_ROWS": 30},
    "items in a table": {"LITERAL_ITEMS": 2},
    "everything large": {"LOCAL_SETS": 0, "TREE_SETS": 5, "TREE_ROWS": 7, "LITERAL_ITEMS": 0},
}


@pytest.mark.parametrize("limits", LIMITS.values(), ids=LIMITS.keys())
def test_every_route_gives_the_same_split(transactions, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(itemsets, name, value)
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 0)
    split = split_population(transactions(ROWS), 0.05)
    wanted = literal.itemsets(ROWS, 0.05)
    assert mined(split.itemsets) == wanted
    assert sorted(r.set_id for r in split.itemsets.collect()) == list(range(len(wanted)))
    full = {}
    for row in histogram.all_histograms(split).collect():
        full.setdefault(tuple(row.itemset), {})[row.target] = (row.n_set, row.n_counter)
    assert set(full) == set(wanted)
    for itemset, cells in full.items():
        inside, outside = literal.split(ROWS, itemset)
        assert cells == {t: (inside.count(t), outside.count(t)) for t in range(6)}


def test_weights_count_rows(spark, transactions):
    merged = (
        transactions(ROWS).groupBy("items", "target").agg(F.sum("weight").alias("weight"))
    )
    assert mined(itemsets.frequent_itemsets(merged, 0.05)) == literal.itemsets(ROWS, 0.05)
    assert mined(itemsets.frequent_itemsets(merged, 0.05, "fpgrowth")) == literal.itemsets(ROWS, 0.05)


@pytest.mark.parametrize("short", [None, 0, 1])
def test_fp_growth_follows_different_transactions(spark, monkeypatch, short):
    """Transactions that come many thousand times are mined in a few copies, with exact counts,
    also where an itemset has just enough support or is ``short`` of one transaction."""
    draw, seen, held = random.Random(3), [], Counter()
    rows = [(sorted(draw.sample("abcdefghij", draw.randrange(6))), 1, draw.choice([1, 7, 1_000, 50_007])) for _ in range(300)]
    for items, _, weight in rows:
        for size in range(1, len(items) + 1):
            held.update(dict.fromkeys(combinations(items, size), weight))
    n = sum(weight for *_, weight in rows)
    support = 0.03 if short is None else (held["c", "f"] + short - 0.5) / n
    frame = spark.createDataFrame(rows, "items array<string>, target bigint, weight bigint")

    class Seen(itemsets.FPGrowth):
        def fit(self, frame):
            seen.append(frame.count())
            return super().fit(frame)

    monkeypatch.setattr(itemsets, "FPGrowth", Seen)
    wanted = {s: freq for s, freq in held.items() if freq >= support * n}
    assert (("c", "f") in wanted) == (short != 1)
    assert mined(itemsets.frequent_itemsets(frame, support, "fpgrowth")) == wanted
    assert seen[0] <= (itemsets.COPIES + 1) * len({tuple(items) for items, *_ in rows}) < n / 100


def test_higher_support_is_part_of_the_split(transactions):
    split = split_population(transactions(ROWS), 0.05).at_least(120)
    direct = split_population(transactions(ROWS), 0.3)
    assert mined(split.itemsets) == mined(direct.itemsets)
    assert split.cells.count() == direct.cells.count()


def test_number_rows_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SINGLE_TASK_ROWS", 10)
    table = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"))
    rows = ranking.number_rows(table, [F.col("v").desc()], "at").collect()
    assert {r.v: r.at for r in rows} == {v: 999 - v for v in range(1000)}


def test_top_percent_rounds_down(spark):
    rules = spark.createDataFrame([([f"i{n}"], n / 10) for n in range(7)], "itemset array<string>, score double")
    assert sorted(r.itemset[0] for r in ranking.top_percent(rules, 40).collect()) == ["i5", "i6"]


def test_repeat_rows_in_chunks(spark):
    table = spark.createDataFrame([(1, 25), (2, 1), (3, 10)], "v int, n int")
    got = itemsets.repeat_rows(table, "n", chunk=10).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {1: 25, 2: 1, 3: 10}


def test_transactions_from_columns_and_facts(spark):
    flat = spark.createDataFrame([("x", None, 3), ("x", None, 3), ("y", "q", 4)], "a string, b string, t int")
    got = {(tuple(r["items"]), r["target"]): r["weight"] for r in from_columns(flat, ["a", "b"], "t").collect()}
    assert got == {(("a=x",), 3): 2, (("a=y", "b=q"), 4): 1}
    facts = spark.createDataFrame([(1, "x", "m", 2), (1, "x", "n", 3), (2, "y", None, 4)], "k int, a string, b string, v int")
    got = {tuple(r["items"]): r["target"] for r in from_facts(facts, "k", {"a": "A", "b": "B"}, F.sum("v")).collect()}
    assert got == {("A=x", "B=m", "B=n"): 5, ("A=y",): 4}
    whole = spark.createDataFrame([(["Yes_Churn", "12", "No_Phone"],)], "row array<string>")
    assert whole.select(keep_marked_items("row")).first()[0] == ["Yes_Churn", "No_Phone"]


def test_item_lookup_with_empty_buckets(spark):
    items = [f"item{n}" for n in range(40)]
    hashed = spark.createDataFrame([(i,) for i in items], "i string").select("i", F.xxhash64("i").alias("h")).collect()
    one = [(row.i, row.h) for row in hashed if row.h % 5 == 2]
    assert one
    padded = one + [(f"pad{n}", 2) for n in range(40 - len(one))]  # five buckets, four of them empty
    lookup = itemsets._item_lookup(padded, {i: n for n, (i, _) in enumerate(padded)})
    got = spark.createDataFrame([(i,) for i in items], "i string").select("i", lookup(F.col("i")).alias("id")).collect()
    assert {r.i: r.id for r in got if r.id is not None} == {i: n for n, (i, _) in enumerate(one)}


def test_many_items(transactions):
    draw = random.Random(2)
    rows = [([f"i{n}" for n in range(150) if draw.random() < 0.03], draw.randint(0, 3)) for _ in range(150)]
    assert mined(itemsets.frequent_itemsets(transactions(rows), 0.02)) == literal.itemsets(rows, 0.02)


def test_no_transactions(transactions):
    split = split_population(transactions([]), 0.1)
    assert split.n == 0 and split.itemsets.count() == 0 and split.cells.count() == 0
