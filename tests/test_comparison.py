import io
import random

import literal
import numpy as np
import pytest

from tallyrift import schemas
from tallyrift.functions import stats
from tallyrift.operators import bootstrap
from tallyrift.operators.bootstrap import bootstrap_divergences, bootstrap_error
from tallyrift.operators.matching import RuleSet, best_percent, match, match_rate, merge, roll_up
from tallyrift.operators.ranking import top_rules
from tallyrift.plans import report
from tallyrift.operators.rollup import roll_up_all
from tallyrift.plans.comparison import match_sweep, rolled_sweep, rules_at, score_all, sweep_rates, sweep_summary
from tallyrift.plans.discovery import score_rules, split_population
from tallyrift.sources import exchange, rule_stream, tables
from pyspark.sql import functions as F


def rule_set(spark, rules):
    """rules: itemset -> (score, values)"""
    heads = [(list(s), score, i) for i, (s, (score, _)) in enumerate(rules.items())]
    cells = [(list(s), v, values.count(v)) for s, (_, values) in rules.items() for v in sorted(set(values))]
    return RuleSet(spark.createDataFrame(heads, schemas.RULES), spark.createDataFrame(cells, schemas.RULE_VALUES))


def content(rules):
    values = {}
    for row in rules.values.collect():
        values.setdefault(tuple(row.itemset), []).extend([row.target] * row.n)
    return {tuple(r.itemset): (r.score, sorted(values[tuple(r.itemset)])) for r in rules.rules.collect()}


def test_merge_match_rate(spark):
    left = rule_set(spark, {("a",): (0.5, [1, 2, 2]), ("b",): (0.4, [3, 4]), ("a", "b"): (0.3, [1])})
    old = rule_set(spark, {("a",): (0.9, [7]), ("c",): (0.2, [5])})
    new = rule_set(spark, {("a",): (0.8, [2, 3]), ("b",): (0.1, [3, 4, 4])})
    right = merge(old, new)
    assert content(right) == {("a",): (0.8, [2, 3]), ("b",): (0.1, [3, 4, 4]), ("c",): (0.2, [5])}
    matched = match(left, right)
    got = {tuple(r.itemset): r for r in matched.collect()}
    assert set(got) == {("a",), ("b",)}
    assert (got[("a",)].left_score, got[("a",)].right_score) == (0.5, 0.8)
    assert got[("a",)].divergence == pytest.approx(literal.symmetric([1, 2, 2], [2, 3]))
    assert got[("b",)].divergence == pytest.approx(literal.symmetric([3, 4], [3, 4, 4]))
    back = {tuple(r.itemset): r.divergence for r in match(right, left).collect()}
    assert back[("a",)] == pytest.approx(got[("a",)].divergence)
    assert match_rate(left, right, matched).first().asDict() == {
        "n_left": 3, "n_right": 3, "n_matched": 2, "match_rate": pytest.approx(200 / 3),
    }


def test_roll_up_keeps_the_first_score(spark):
    rules = rule_set(
        spark, {("40199_diagnose", "male"): (0.2, [1]), ("4011_diagnose", "male"): (0.9, [1, 2]), ("male",): (0.1, [3])}
    )
    assert content(roll_up(rules, 0)) == {("401_diagnose", "male"): (0.2, [1, 1, 2]), ("male",): (0.1, [3])}
    assert len(content(roll_up(rules, 1))) == 3


def test_rule_lines(spark, tmp_path):
    lines = ["male,4019_diagnose;0.1234;1,2,2,5", "female;1.2E-4,3,4", "x;9.0;1", "x;0.5;7*2,8"]
    (tmp_path / "rules.txt").write_text("\n".join(lines) + "\n")
    got = content(exchange.read_rule_lines(spark, str(tmp_path / "rules.txt")))
    assert got == {
        ("4019_diagnose", "male"): (0.1234, [1, 2, 2, 5]), ("female",): (1.2e-4, [3, 4]), ("x",): (0.5, [7, 7, 8]),
    }
    rules = rule_set(spark, {("a", "b"): (-0.25, [1, 1, 3]), ("c",): (3.0e-5, [2])})
    for counted in (True, False):
        path = str(tmp_path / f"lines-{counted}")
        exchange.write_rule_lines(rules, path, counted)
        assert content(exchange.read_rule_lines(spark, path)) == content(rules)


def test_rule_store_and_value_files(spark, tmp_path):
    rules = rule_set(spark, {("a",): (0.5, [1, 2, 2])})
    other = rule_set(spark, {("b",): (0.1, [9])})
    tables.write_rule_set(rules, str(tmp_path / "store"), "d", "kl", 0.05)
    tables.write_rule_set(other, str(tmp_path / "store"), "d", "kl", 0.1)
    assert content(tables.read_rule_set(spark, str(tmp_path / "store"), "d", "kl", 0.05)) == content(rules)
    tables.write_values(rules.values, str(tmp_path / "values"))
    assert {r.target: r.n for r in tables.read_values(spark, str(tmp_path / "values")).collect()} == {1: 1, 2: 2}


def test_csv_index_column_is_dropped(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"",code,n\n1,x,4\n2,y,5\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("x", 4), ("y", 5)]
    (tmp_path / "m.csv").write_text("id,name\n1,x\n")
    assert tables.read_csv(spark, str(tmp_path / "m.csv"), schemas.CODE_MAPPING).columns == ["icd_code_dia_id", "icd_code_dia"]


@pytest.fixture(scope="module")
def split(spark):
    draw = random.Random(3)
    rows = [([i for i in "abc" if draw.random() < 0.4], int(draw.expovariate(0.3)), 1) for _ in range(400)]
    return split_population(spark.createDataFrame(rows, schemas.TRANSACTIONS), 0.05)


def test_sweep(split):
    matched = match_sweep(split, [split], [0.05, 0.2], [50, 100])
    assert all(r.divergence == pytest.approx(0) for r in matched.collect())
    counts = {(r.min_support, r.percent): r.n_matched for r in sweep_summary(matched).collect()}
    assert counts[(0.05, 100)] == rules_at(split, 0.05).rules.count()
    assert counts[(0.05, 50)] == counts[(0.05, 100)] // 2


def test_reports(split):
    histograms = report.rule_histograms(split, top_rules(score_rules(split, "kl")), 2)
    raw = {}
    for row in report.value_lists(histograms).collect():
        raw.setdefault((row["rank"], row.side), []).append(row.target)
    summary = {r["rank"]: r for r in report.rule_summary(histograms).collect()}
    for rank in (1, 2):
        values = raw[(rank, "set")]
        assert len(values) + len(raw[(rank, "counter_set")]) == 400
        assert summary[rank].support == len(values)
        assert summary[rank].sd == pytest.approx(np.std(values, ddof=1))
        assert summary[rank].iqr == pytest.approx(np.subtract(*np.percentile(values, [75, 25])))
        assert summary[rank].median == pytest.approx(np.median(values))
    shared = report.shared_distribution(histograms).filter("rank = 1").collect()
    assert shared[0].annotation == pytest.approx(literal.kl(raw[(1, "set")], raw[(1, "counter_set")]), abs=1e-4)
    assert report.melted(report.shared_distribution(histograms)).filter("rank = 1").count() == 2 * len(shared)
    for fit in ("expo", "normal", "mean"):
        rel = report.fitted_distribution(histograms, fit).groupBy("rank", "side").agg(F.sum("rel").alias("s")).collect()
        assert all(r.s == pytest.approx(1) for r in rel)


def test_normal_distribution_function(spark):
    from math import erfc, sqrt

    points = spark.createDataFrame([(i / 8 - 9,) for i in range(145)] + [(40.0,), (-40.0,)], "z double")
    for row in points.select("z", stats.normal_cdf(F.col("z")).alias("cdf")).collect():
        assert row.cdf == pytest.approx(0.5 * erfc(-row.z / sqrt(2)), abs=1e-15)


def test_bootstrap(split):
    histograms = report.rule_histograms(split, top_rules(score_rules(split, "kl")), 1)
    first = sorted(tuple(r) for r in bootstrap_divergences(histograms, 300, 1).collect())
    assert first == sorted(tuple(r) for r in bootstrap_divergences(histograms.repartition(7, "target"), 300, 1).collect())
    assert [r[1] for r in first] == list(range(300))
    error = bootstrap_error(histograms, 4000, 2).first()
    cells = histograms.orderBy("target").collect()
    inside = np.repeat([c.target for c in cells], [c.n_set for c in cells])
    outside = np.repeat([c.target for c in cells], [c.n_counter for c in cells])
    rng = np.random.default_rng(9)
    drawn = [
        literal.kl(list(rng.choice(inside, len(inside))), list(rng.choice(outside, len(outside)))) for _ in range(2000)
    ]
    assert error.replicates == 4000
    assert error.standard_error == pytest.approx(np.std(drawn, ddof=1), rel=0.1)
    assert error.error_bar == pytest.approx(round(error.standard_error, 2))


def test_sparse_cells_agree(spark):
    """Values that a draw may lose, where the closed form of first order is off by more than
    the tolerance: few counts on the set side, on the counter side, and on both."""
    sides = {
        1: [(1, 3), (2, 2), (4, 1), (40, 900), (60, 1500), (30, 200), (1, 40), (1, 60), (2, 30), (1, 90)] * 4,
        2: [(n % 3 + 1, 7 * n % 25 + 1) for n in range(120)],
        3: [(1, 1), (700, 3000), (1, 2000), (90_000, 1)],
    }
    rows = [(rank, t, *counts) for rank, cells in sides.items() for t, counts in enumerate(cells)]
    frame = spark.createDataFrame(rows, "rank int, target bigint, n_set bigint, n_counter bigint")
    drawn = {r.rank: r.standard_error for r in bootstrap_error(frame, 4000).collect()}
    known = {r.rank: r.resampled for r in bootstrap.resampled_error(frame.repartition(3)).collect()}
    checked = {r.rank: r for r in bootstrap.checked_error(frame, 4000, 0.25).collect()}
    assert known == pytest.approx(drawn, rel=0.05)
    assert any(abs(drawn[rank] - r.closed_form) > 0.25 * r.closed_form for rank, r in checked.items())
    assert all(r.agrees and r.mean_agrees for r in checked.values()) and len(checked) == 3


def test_sweep_agrees_on_sparse_values(transactions):
    """Both supports, on targets that hardly repeat inside a rule."""
    rng = random.Random(5)
    rows = [((["a"] if n % 10 == 0 else []) + (["b"] if n % 4 == 1 else []) + ["c"] * (n % 3 > 0), rng.randrange(300) + 20 * (n % 10 == 0)) for n in range(6000)]
    split = split_population(transactions(rows), 0.05)
    bars = report.error_bars(split, "mean", (0.05, 0.2), replicates=2000, tolerance=0.25).collect()
    assert sorted((r.min_support, r.rank) for r in bars) == [(0.05, 1), (0.05, 2), (0.2, 1), (0.2, 2)]
    assert all(r.agrees and r.mean_agrees for r in bars)


@pytest.mark.parametrize("values", [1, 3, 1000])
def test_draws_go_down_the_tree_whole(spark, monkeypatch, values):
    """Blocks of any size give one multinomial: replicate sizes are exact, and so are the
    variance of one cell and the covariance of two."""
    monkeypatch.setattr(bootstrap, "BLOCK_VALUES", values)
    cells = [(1, t, n, 10) for t, n in enumerate([50, 30, 0, 15, 5, 100])]
    # targets that make the mean difference tell one cell's share, or the sum of all shares
    def shares(targets):
        rows = [(1, x, n, m) for (_, _, n, m), x in zip(cells, targets)]
        frame = spark.createDataFrame(rows, "rank int, target bigint, n_set bigint, n_counter bigint")
        return np.array([r.difference for r in bootstrap_divergences(frame, 4000, 5).orderBy("replicate").collect()])

    spread = shares([0, 1, 2, 3, 4, 5])
    counts = np.array([c[2] for c in cells])
    p, q = counts / counts.sum(), np.full(6, 1 / 6)
    x = np.arange(6)
    exact = (p @ x**2 - (p @ x) ** 2) / counts.sum() + (q @ x**2 - (q @ x) ** 2) / 60
    assert spread.mean() == pytest.approx(p @ x - q @ x, abs=4 * np.sqrt(exact / 4000))
    assert spread.std() == pytest.approx(np.sqrt(exact), rel=0.05)
    shifted = shares([7_000_000 + i for i in range(6)])  # a lost or doubled count would show as millions
    assert abs(shifted).max() < 10


def test_sweep_in_one_plan_equals_the_settings_one_by_one(transactions):
    draw = random.Random(9)
    items = [f"{c}_diagnose" for c in ("40199", "4011", "25000", "25012")] + ["male", "urgent"]

    def mined(count):
        rows = [([i for i in items if draw.random() < 0.5], draw.randint(0, 5)) for _ in range(count)]
        return split_population(transactions(rows), 0.1)

    left, *rights = mined(150), mined(120), mined(130)
    supports, percents = (0.1, 0.2), (40, 100)
    shown = lambda rows: sorted((r.min_support, r.percent, tuple(r.itemset), round(r.left_score, 9), round(r.right_score, 9), round(r.divergence, 9)) for r in rows.collect())
    got, sizes = shown(match_sweep(left, rights, supports, percents)), {}
    wanted = []
    for support in supports:
        for percent in percents:
            sets = [best_percent(rules_at(split, support), percent) for split in (left, *rights)]
            right = merge(*sets[1:])
            matched = match(sets[0], right)
            wanted += shown(matched.withColumns({"min_support": F.lit(support), "percent": F.lit(percent)}))
            sizes[support, percent] = (sets[0].rules.count(), right.rules.count(), matched.count())
    assert got == sorted(wanted)
    rates = {(r.min_support, r.percent): (r.n_left, r.n_right, r.n_matched) for r in sweep_rates(left, rights, supports, percents).collect()}
    assert rates == sizes


def test_shortened_sweep_equals_the_settings_one_by_one(transactions):
    """All depths and supports at once give what a rule set per setting gives, values included."""
    draw = random.Random(11)
    items = [f"{c}_diagnose" for c in ("40199", "40191", "4011", "4010", "25000", "25012")] + ["4019_procedure", "male"]

    def mined(count):
        rows = [([i for i in items if draw.random() < 0.4], draw.randint(0, 5)) for _ in range(count)]
        return split_population(transactions(rows), 0.1)

    sides = mined(150), mined(120), mined(130)
    supports, percents, depths = (0.2, 0.1), (40, 100), (1, 0)
    scores = [score_all(split) for split in sides]
    direct = {
        (d, s): [roll_up(rules_at(split, s, scored), d) for split, scored in zip(sides, scores)] for d in depths for s in supports
    }
    at_once = roll_up_all(sides[0], scores[0], supports, depths)
    for (d, s), (rolled, *_) in direct.items():
        here = f"depth = {d} AND min_support = {s}D"
        mine = at_once.rules.filter(here)
        values = at_once.values.filter(here).join(mine.select("node", "itemset"), "node").select("itemset", "target", "n")
        assert content(RuleSet(mine, values)) == content(rolled)
    shown = lambda rows: sorted((r.depth, r.min_support, r.percent, tuple(r.itemset), round(r.left_score, 9), round(r.right_score, 9), round(r.divergence, 9)) for r in rows.collect())
    got, wanted = shown(rolled_sweep(sides[0], sides[1:], supports, percents, depths)), []
    for (d, s), sets in direct.items():
        for percent in percents:
            left, *rights = (best_percent(rules, percent) for rules in sets)
            matched = match(left, merge(*rights))
            wanted += shown(matched.withColumns({"depth": F.lit(d), "min_support": F.lit(s), "percent": F.lit(percent)}))
    assert got == sorted(wanted)
    assert any(g[0] == 1 and "4019_diagnose" in g[3] for g in got) and any(g[0] == 0 and "401_diagnose" in g[3] for g in got)
    one = match_sweep(sides[0], sides[1:], supports, percents, depth=0).withColumn("depth", F.lit(0))
    assert shown(one) == [g for g in got if g[0] == 0]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_rule_stream_in_pieces_of_any_size(tmp_path, monkeypatch, piece):
    """Ranges and pieces may end anywhere in a line; every line is read once and whole."""
    monkeypatch.setattr(rule_stream, "PIECE_BYTES", piece)
    lines = ["b,a;0.5;1*2,30,4*5", "", "ü%2C;1.5E-3,7,7", "empty;2.0;", "z;-1.0;-3*4\r", "last;0.25;8"]
    want = {"b,a": (0.5, [(1, 2), (30, 1), (4, 5)]), "ü%2C": (1.5e-3, [(7, 1), (7, 1)]), "empty": (2.0, []), "z": (-1.0, [(-3, 4)]), "last": (0.25, [(8, 1)])}
    data = "\n".join(lines).encode()
    for step in (1, 5, 13, len(data)):
        rows = []
        for at in range(0, len(data), step):
            for batch in rule_stream.read_range(io.BytesIO(data), rule_stream.Range("f", at, min(at + step, len(data)))):
                rows += batch.to_pylist()
        heads = {r["at"]: (r["items"], float(r["score"])) for r in rows if r["items"] is not None}
        got = {name: (score, [(r["target"], r["n"]) for r in rows if r["at"] == at and r["items"] is None]) for at, (name, score) in heads.items()}
        assert got == want and sum(r["items"] is not None for r in rows) == len(want)
    with pytest.raises(ValueError, match="no rule line: nonsense"):
        list(rule_stream.read_range(io.BytesIO(b"a;1;2\nnonsense\n"), rule_stream.Range("f", 0, 15)))


def test_rule_stream_round_trip(spark, tmp_path):
    rules = rule_set(spark, {("a,;", "b%\n"): (-0.25, [1, 1, 3]), ("c",): (3.0e-5, [2])})
    many = spark.range(300_000).select(F.array(F.lit("wide")).alias("itemset"), F.col("id").alias("target"), F.lit(2).cast("bigint").alias("n"))
    head = spark.createDataFrame([(["wide"], 1.0, 2)], schemas.RULES)
    rules = RuleSet(rules.rules.unionByName(head), rules.values.unionByName(many))
    for counted in (True, False):
        path = f"file:{tmp_path}/stream-{counted}"
        rule_stream.write_rule_stream(rules, path, counted)
        got = rule_stream.read_rule_stream(spark, path)
        sums = lambda r: sorted((tuple(x.itemset), x.c, x.n, x.t) for x in r.values.groupBy("itemset").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("target")).alias("t")).collect())
        assert sums(got) == sums(rules)
        assert [(tuple(r.itemset), r.score) for r in got.rules.orderBy("position").collect()] == [(("a,;", "b%\n"), -0.25), (("c",), 3.0e-5), (("wide",), 1.0)]
        assert sums(exchange.read_rule_lines(spark, path)) == sums(rules)
        with pytest.raises(FileExistsError):
            rule_stream.write_rule_stream(rules, path)
    small = rule_set(spark, {("c",): (0.5, [2])})
    rule_stream.write_rule_stream(small, path, mode="overwrite")
    assert content(rule_stream.read_rule_stream(spark, path)) == content(small)
    rule_stream.write_rule_stream(rule_set(spark, {("d",): (0.75, [4, 4])}), path, mode="append")
    assert len(content(rule_stream.read_rule_stream(spark, path))) == 2
