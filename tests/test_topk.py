"""Branch and bound against exhaustive runs."""

import random

import pytest

from tallyrift.operators import itemsets, topk
from tallyrift.plans.discovery import discover_best, discover_rules, score_rules, split_population


def rows_with_a_few_strong_items(seed, count=600, low=1):
    draw = random.Random(seed)
    rows = []
    for _ in range(count):
        items = [i for i in "abcdefghij" if draw.random() < 0.4]
        rows.append((items, low + draw.randint(0, 30) + 40 * ("a" in items and "b" in items) + 9 * ("c" in items)))
    return rows


def plain(rules):
    return [(r.rank, r.itemset, r.freq, r.n_counter, round(r.mean, 9), round(r.score, 9)) for r in rules.orderBy("rank").collect()]


@pytest.mark.parametrize("measure", ["mean", "expo"])
@pytest.mark.parametrize("limits", [{}, {"LOCAL_SETS": 4, "TREE_SETS": 3}, {"LOCAL_SETS": 0}], ids=["listed", "few listed", "tables"])
def test_bounded_rules_equal_all_rules(transactions, monkeypatch, measure, limits):
    table = transactions(rows_with_a_few_strong_items(1))
    want = plain(discover_rules(table, 0.05, measure, 5))
    everything = split_population(table, 0.05).itemsets.count()
    for name, value in limits.items():
        monkeypatch.setattr(itemsets, name, value)
    rules, visited = discover_best(table, 0.05, measure, 5)
    assert plain(rules) == want
    seen = sum(v["frequent"] for v in visited)
    assert seen < everything if measure == "mean" else seen <= everything, "sets that cannot win are not counted"
    assert all(v["extended"] <= v["frequent"] <= v["counted"] for v in visited)


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_classes_change_only_how_much_is_visited(transactions, monkeypatch, bins):
    monkeypatch.setattr(topk, "BINS", bins)
    for seed, low in ((2, 1), (3, -20)):  # negative targets too
        table = transactions(rows_with_a_few_strong_items(seed, 300, low))
        assert plain(discover_best(table, 0.1, "mean", 3)[0]) == plain(discover_rules(table, 0.1, "mean", 3))


def test_no_bound_is_below_a_score_it_covers(transactions):
    """The bound of every itemset against the scores of all itemsets that hold it."""
    table = transactions(rows_with_a_few_strong_items(4, 300))
    encoded = itemsets.encode(table, 0.05)
    found, count = itemsets.mine(encoded)
    for measure in topk.MEASURES:
        wanted = found.selectExpr("set_id AS at", "ids")
        counted = itemsets.held_by(encoded.rows, wanted, count, by_target=True)
        scored = topk._scored(counted, encoded, measure, *topk._population(encoded))
        rows = [(frozenset(r.ids), r.score, r.bound) for r in scored.join(wanted, "at").collect()]
        assert len(rows) == count
        for ids, _, bound in rows:
            assert all(score <= bound + 1e-9 for other, score, _ in rows if ids <= other)


def test_ties_and_sets_of_everybody(transactions):
    rows = [(["x", "b"], 1), (["x", "a"], 1), (["x", "c"], 2), (["x"], 5)]
    rules, visited = discover_best(transactions(rows), 0.25, "mean", 2)
    assert plain(rules) == plain(discover_rules(transactions(rows), 0.25, "mean", 2))
    assert discover_best(transactions([]), 0.1)[0].count() == 0
    with pytest.raises(ValueError):
        discover_best(transactions(rows), 0.25, "kl")
