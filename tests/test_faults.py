"""Cases that once gave wrong or incomplete results without an error."""

import random

import literal
import pytest
from pyspark.sql import functions as F

from tallyrift import schemas, session
from tallyrift.operators import dictionary, itemsets
from tallyrift.operators.matching import RuleSet
from tallyrift.operators.transactions import from_columns, from_facts
from tallyrift.plans import clinical, report
from tallyrift.plans.comparison import rules_at
from tallyrift.plans.discovery import split_population
from tallyrift.sources import exchange, tables

DRAW = random.Random(3)
ROWS = [([f"i{n}" for n in range(40) if DRAW.random() < 0.2], DRAW.randint(0, 4)) for _ in range(200)]


@pytest.mark.parametrize("sizes", [{"insurance": 95, "procedure": 19_500}, {"insurance": 3}])
def test_item_ranges_never_overlap(spark, sizes):
    kinds = {"insurance": 2, "admission_type": 2, "procedure": 2, "diagnose": 2} | sizes
    codes = {
        kind: spark.range(1, n + 1).select(F.col("id").cast("int").alias(f"{kind}_id"), F.format_string(f"{kind[0].upper()}%05d", "id").alias(kind))
        for kind, n in kinds.items()
    }
    starts = dictionary.namespace_starts(codes)
    table = dictionary.item_dictionary(codes, starts)
    assert table.count() == table.select("item").distinct().count() == 2 + sum(kinds.values())
    stays = spark.createDataFrame(
        [(1, 4, 0, kinds["insurance"], 1, [kinds["procedure"]], [1, 2])],
        "hadm_id int, icu_los bigint, gender int, insurance_id int, admission_type_id int, procedure_ids array<int>, diagnose_ids array<int>",
    )
    rows = clinical.offset_transactions(stays, starts).select(F.lit(1).alias("k"), "items")
    got = dictionary.decode_items(rows, table, "k", "items").first().itemset
    assert got == sorted(["female", f"I{kinds['insurance']:05d}", "A00001", f"P{kinds['procedure']:05d}_procedure", "D00001_diagnose", "D00002_diagnose"])
    if kinds["insurance"] > 90:
        with pytest.raises(Exception, match="beyond its range"):
            clinical.offset_transactions(stays).collect()


def test_a_lower_support_than_mined_is_refused(transactions):
    split = split_population(transactions(ROWS), 0.3)
    for ask in (lambda: rules_at(split, 0.05), lambda: split.at_least(10), lambda: report.error_bars(split, "kl", (0.05,))):
        with pytest.raises(ValueError, match="mined with"):
            ask()
    assert rules_at(split, 0.3).rules.count() >= 0


def test_fractions_are_no_targets(spark):
    rows = spark.createDataFrame([("a", 3.0), ("a", -2.0), (None, None)], "x string, t double")
    assert sorted(r.target for r in from_columns(rows, ["x"], "t").collect()) == [-2, 3]
    for value in (3.7, 0.2, -0.5):
        with pytest.raises(Exception, match="no whole number"):
            from_columns(spark.createDataFrame([("a", value)], "x string, t double"), ["x"], "t").collect()
        with pytest.raises(Exception, match="no whole number"):
            from_facts(spark.createDataFrame([(1, "a", value)], "k int, x string, t double"), "k", {"x": "x"}, F.sum("t")).collect()


def rule_set(spark, itemsets_):
    rules = [(s, 0.5 - i / 10, i) for i, s in enumerate(itemsets_)]
    return RuleSet(spark.createDataFrame(rules, schemas.RULES), spark.createDataFrame([(s, 7, 2) for s in itemsets_], schemas.RULE_VALUES))


def test_rule_lines_keep_every_item(spark, tmp_path):
    odd = [["city=Paris, TX"], ["a;b", "c\nd"], ["100%", "50%2C"], ["plain"]]
    exchange.write_rule_lines(rule_set(spark, odd), f"{tmp_path}/lines")
    back = exchange.read_rule_lines(spark, f"{tmp_path}/lines")
    assert sorted(r.itemset for r in back.rules.collect()) == sorted(odd)
    assert {r.n for r in back.values.collect()} == {2}
    spark.createDataFrame([("a;0.5;1,2",), ("",), ("no rule here",)], "value string").coalesce(1).write.text(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="no rule line: no rule here"):
        exchange.read_rule_lines(spark, f"{tmp_path}/bad")


def test_repeated_lines_in_a_file(spark, tmp_path):
    lines = [("b,a;0.5;1,2,2",), ("c;1E-2,4",), ("a,b;0.25;9*3",)]
    spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{tmp_path}/lines")
    read = exchange.read_rule_lines(spark, f"{tmp_path}/lines")
    assert [(r.itemset, r.score) for r in read.rules.collect() if r.itemset != ["c"]] == [(["a", "b"], 0.25)]


def test_a_second_write_replaces_the_first(spark, tmp_path):
    rules = rule_set(spark, [["a"], ["b"]])
    for support in (0.1, 0.2, 0.1):
        tables.write_rule_set(rules, str(tmp_path), "d", "kl", support)
    for support in (0.1, 0.2):
        back = tables.read_rule_set(spark, str(tmp_path), "d", "kl", support)
        assert back.rules.count() == 2 and back.values.count() == 2


def test_unknown_ids_stay(spark):
    table = spark.createDataFrame([(1, "male")], "item int, item_text string")
    rules = spark.createDataFrame([(1, ["1", "77"]), (2, ["88"]), (3, ["x"]), (4, [])], "set_id int, items array<string>")
    got = {r.set_id: r.itemset for r in dictionary.decode_items(rules, table, "set_id", "items").collect()}
    assert got == {1: ["77", "male"], 2: ["88"], 3: ["x"], 4: []}


def test_uncounted_lines_refuse_huge_counts(spark):
    rules = RuleSet(spark.createDataFrame([(["a"], 0.5, 0)], schemas.RULES), spark.createDataFrame([(["a"], 7, 2**31)], schemas.RULE_VALUES))
    with pytest.raises(Exception, match="too many copies"):
        exchange.rule_lines(rules, counted=False).collect()


@pytest.mark.parametrize("limit", [0, 1000])
def test_both_dictionaries_encode_alike(transactions, monkeypatch, limit):
    monkeypatch.setattr(itemsets, "LITERAL_ITEMS", limit)
    rows = ROWS + [([None, "i1", "i1"], 9), ([], 9)]
    encoded = itemsets.encode(transactions(rows), 0.1)
    names = {r.id: r.item for r in encoded.items.collect()}
    known = {i for items, _ in rows for i in set(items) if i is not None and sum(i in other for other, _ in rows) >= 0.1 * len(rows)}
    assert set(names.values()) == known
    got = sorted((tuple(sorted(names[i] for i in r.ids)), r.target) for r in encoded.rows.collect() for _ in range(r.weight))
    assert got == sorted((tuple(sorted(set(items) & known)), t) for items, t in rows)
    found = {tuple(r.itemset): r.freq for r in itemsets.frequent_itemsets(transactions(rows), 0.02).collect()}
    assert found == literal.itemsets(rows, 0.02)


def test_pairs_are_only_those_held(transactions):
    encoded = itemsets.encode(transactions(ROWS), 0.01)
    held = sum(r.weight * len(r.ids) * (len(r.ids) - 1) // 2 for r in encoded.rows.collect())
    assert itemsets._pairs(encoded.rows, encoded.width).agg(F.sum("freq")).first()[0] == held


def test_text_times(spark):
    rows = spark.createDataFrame([("2020-01-02 03:04:05", 1), (None, 2)], "t string, n int")
    got = clinical.parsed_times(rows, ["t"]).orderBy("n").collect()
    assert got[0].t.isoformat() == "2020-01-02T03:04:05" and got[1].t is None
    with pytest.raises(Exception, match="(?i)pars"):
        clinical.parsed_times(spark.createDataFrame([("2 Jan",)], "t string"), ["t"]).collect()


def test_index_column_of_a_file(spark, tmp_path):
    spark.createDataFrame([(0, "a", 5)], "`_c0` int, x string, n int").write.option("header", True).csv(f"{tmp_path}/c")
    assert [tuple(r) for r in tables.read_csv(spark, f"{tmp_path}/c").collect()] == [("a", 5)]


class Settings:
    """As much of a session as the choice of a folder reads."""

    def __init__(self, master, **conf):
        self.sparkContext, self.conf = self, self
        self.master, self.known = master, {"spark.sql.warehouse.dir": "file:/tmp/warehouse", **conf}

    def get(self, key, default=None):
        return self.known.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Settings("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_folder(Settings("local-cluster[2,1,1024]", **{"spark.sql.warehouse.dir": "/tmp/warehouse"}))
    assert session.shared_folder(Settings("local[4]")).startswith("file:/tmp/warehouse/")
    assert session.shared_folder(Settings("yarn", **{"spark.sql.warehouse.dir": "hdfs://name/warehouse"})).startswith("hdfs://name/")
    assert session.shared_folder(Settings("yarn", **{"spark.checkpoint.dir": "file:///mnt/shared"})).startswith("file:///mnt/shared/")


def test_intermediate_tables_lie_below_the_shared_folder(spark, tmp_path):
    folder = session.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    table = session.materialize(spark.range(3), "numbers")
    assert table.count() == 3 and all(folder in f for f in table.inputFiles())
