import math
import random

import literal
import pytest

from tallyrift.operators import measures
from tallyrift.plans.discovery import discover_rules, score_rules, split_population

MICRO = [(["a", "b"], 1), (["a", "b"], 2), (["a"], 2), (["b"], 3), (["a", "c"], 1), (["c"], 4)]
# itemset -> KL, fits to the exponential, exponential KL, fits to the normal, normal KL, mean difference, z
EXPECTED = {
    ("a",): (0.0, 1.045651, 1.702473, 0.486035, -0.099257, -0.018724, 18.219535, -2.0, -4.618802),
    ("b",): (0.0, 0.844535, 0.962971, 0.012516, -0.008671, 0.329317, 1.430480, -0.333333, -0.387298),
    ("c",): (-0.173287, 1.423144, 0.903426, 0.023144, 0.613915, 0.031507, 1.426689, 0.5, 0.447214),
    ("a", "b"): (-0.346574, 1.045651, 0.729996, 0.155841, -0.018724, 0.009793, 5.851583, -1.0, -1.511858),
}


def by_itemset(rules):
    return {tuple(row.itemset): row for row in rules.collect()}


def test_micro_fixture(transactions):
    split = split_population(transactions(MICRO), 2 / 6)
    scored = {m: by_itemset(score_rules(split, m)) for m in ("kl", "expo", "normal", "mean")}
    assert {s: r.freq for s, r in scored["kl"].items()} == {("a",): 4, ("b",): 3, ("c",): 2, ("a", "b"): 2}
    for itemset, want in EXPECTED.items():
        kl, expo, normal, mean = (scored[m][itemset] for m in ("kl", "expo", "normal", "mean"))
        got = (
            kl.score, expo.fit_set, expo.fit_counter, expo.score,
            normal.fit_set, normal.fit_counter, normal.score, mean.score, mean.z,
        )
        assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("seed,offset", [(1, 0), (2, 1_000_000)])
def test_random_rows_against_definitions(transactions, seed, offset):
    draw = random.Random(seed)
    rows = [
        ([i for i in "abcde" if draw.random() < 0.5], offset + int(draw.expovariate(0.2)) + 1) for _ in range(300)
    ]
    split = split_population(transactions(rows), 0.1)
    scored = {m: by_itemset(score_rules(split, m)) for m in ("kl", "expo", "normal", "mean")}
    wanted = literal.itemsets(rows, 0.1)
    assert set(scored["kl"]) == set(wanted)
    for itemset, freq in wanted.items():
        inside, outside = literal.split(rows, itemset)
        row = scored["kl"][itemset]
        assert (row.freq, row.n_counter) == (freq, len(outside))
        assert row.mean == pytest.approx(literal.mean(inside), rel=1e-12)
        assert row.score == pytest.approx(literal.kl(inside, outside), abs=1e-9)
        row = scored["mean"][itemset]
        assert row.score == pytest.approx(literal.mean(inside) - literal.mean(outside), abs=1e-7)
        assert row.z == pytest.approx(literal.welch_z(inside, outside), rel=1e-6, abs=1e-6)
        row = scored["expo"][itemset]
        assert row.fit_set == pytest.approx(literal.expo_fit(inside), abs=1e-8)
        assert row.fit_counter == pytest.approx(literal.expo_fit(outside), abs=1e-8)
        assert row.score == pytest.approx(literal.expo_kl(inside, outside), abs=1e-9)
        row = scored["normal"][itemset]
        assert row.fit_set == pytest.approx(literal.normal_fit(inside), abs=1e-6)
        assert row.fit_counter == pytest.approx(literal.normal_fit(outside), abs=1e-6)
        assert row.score == pytest.approx(literal.normal_kl(inside, outside), rel=1e-6, abs=1e-9)


def test_edges(transactions):
    # "x" is everywhere, "twice" is listed twice, one item is null, "one" has a single value
    rows = [(["x", "twice", "twice", None], 0), (["x", "one"], 5), (["x", "one"], 5), (["x"], 2), ([], 3)]
    rows = [(items + ["x"] if "x" not in items else items, t) for items, t in rows]
    split = split_population(transactions(rows), 0.2)
    kl = by_itemset(score_rules(split, "kl"))
    assert ("x",) not in kl, "nobody is outside, so there is nothing to compare"
    assert kl[("twice",)].freq == 1 and kl[("twice", "x")].freq == 1
    kept = by_itemset(score_rules(split, "kl", require_counter=False))
    assert kept[("x",)].score is None and kept[("x",)].n_counter == 0
    expo = by_itemset(score_rules(split, "expo"))
    assert ("twice",) not in expo, "a mean of 0 has no rate"
    normal = by_itemset(score_rules(split, "normal", require_counter=False))
    assert normal[("one",)].var_set == 0 and normal[("one",)].fit_set == 0 and normal[("one",)].score is None
    assert normal[("twice",)].var_set is None


def test_no_frequent_item(transactions):
    assert discover_rules(transactions([(["a"], 1), (["b"], 2), (["c"], 3)]), 0.9).count() == 0


def test_ties_are_broken_by_itemset(transactions):
    rows = [(["b"], 1), (["a"], 1), (["c"], 2), ([], 5)]
    ranked = [r.itemset for r in discover_rules(transactions(rows), 0.25, "mean").orderBy("rank").collect()]
    assert ranked == [["c"], ["a"], ["b"]]


def test_invariants(transactions):
    draw = random.Random(5)
    rows = [([i for i in "abcd" if draw.random() < 0.6], draw.randint(0, 9)) for _ in range(200)]
    split = split_population(transactions(rows), 0.1)
    sums = {r.set_id: r["sum(n_set)"] for r in split.cells.groupBy("set_id").sum("n_set").collect()}
    support = {}
    for row in split.itemsets.collect():
        assert sums[row.set_id] == row.freq
        support[tuple(row.itemset)] = row.freq
    for itemset, freq in support.items():
        for i in range(len(itemset)):
            part = itemset[:i] + itemset[i + 1 :]
            assert not part or support[part] >= freq
    assert all(r.score >= -1e-12 for r in score_rules(split, "expo").collect())
    assert math.isclose(sum(t.n_tot for t in split.totals.collect()), 200)


def test_fit_threshold_and_formula(transactions):
    split = split_population(transactions(MICRO), 2 / 6)
    kept = by_itemset(score_rules(split, "expo", fit_threshold=1.0))
    assert set(kept) == {("b",)}
    assert set(by_itemset(score_rules(split, "normal", fit_threshold=0.0))) == {("a",)}
    textbook = by_itemset(score_rules(split, "normal", formula="textbook"))[("b",)]
    vp, vq = 7 / 3, 1.0
    assert textbook.score == pytest.approx(0.5 * ((1 / 3) ** 2 / vq + vp / vq + math.log(vq / vp) - 1))
    significant = by_itemset(score_rules(split, "mean", significant=True))
    assert set(significant) == {("a",)}
    with pytest.raises(ValueError):
        score_rules(split, "median")


@pytest.mark.parametrize("values", [1, 2, 5, 1 << 16])
def test_normal_fits_over_ranges_of_values(transactions, monkeypatch, values):
    """Many values vanish on one side, at both ends and in runs longer than a range."""
    monkeypatch.setattr(measures, "RANGE_VALUES", values)
    draw = random.Random(values)
    rows = [(["low"] * (x < 9) + ["high"] * (x > 30) + ["middle"] * (12 <= x <= 25) + [i for i in "ab" if draw.random() < 0.5], x) for x in range(40) for _ in range(draw.randint(1, 2))]
    rows += [(["ends", "a"], 0), (["ends"], 39), (["ends", "b"], 39)]
    split = split_population(transactions(rows), 0.03)
    scored = by_itemset(score_rules(split, "normal", require_counter=False))
    wanted = literal.itemsets(rows, 0.03)
    assert set(scored) == set(wanted)
    for itemset in wanted:
        inside, outside = literal.split(rows, itemset)
        row = scored[itemset]
        for side, fit, variance in ((inside, row.fit_set, row.var_set), (outside, row.fit_counter, row.var_counter)):
            if len(set(side)) > 1:
                assert fit == pytest.approx(literal.normal_fit(side), abs=1e-9), (itemset, side)
                assert variance == pytest.approx(literal.variance(side, 1))
