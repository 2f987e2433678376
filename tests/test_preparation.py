import datetime

import pytest
from pyspark.sql import functions as F

from tallyrift import schemas
from tallyrift.functions import text
from tallyrift.operators import dictionary, profile
from tallyrift.plans import clinical, flat


def day(n):
    return datetime.datetime(2020, 1, n)


def test_first_database(spark):
    admissions = spark.createDataFrame(
        [(1, "URGENT", "Medicare", 0), (2, "ELECTIVE", "Other", 0), (3, "URGENT", "Other", 1), (4, "URGENT", "Other", 0)],
        schemas.ADMISSIONS,
    )
    diagnoses = spark.createDataFrame(
        [(1, "4019", 9), (1, "4019", 9), (1, "I10", 10), (2, "V30", 9), (3, "I10", 10)], schemas.CODES
    )
    procedures = spark.createDataFrame([(1, "9904", 9), (2, "9904", 9), (3, "9904", 9), (4, "9904", 9)], schemas.CODES)
    stays = spark.createDataFrame(
        [
            (10, 1, 2.9, day(2)), (10, 1, 7.5, day(5)),
            (20, 2, 1.2, day(3)), (20, 2, 4.8, day(3)),  # two stays start at once
            (30, 3, 1.0, day(1)), (40, 4, 1.0, day(1)),
        ],
        schemas.STAYS,
    )
    patients = spark.createDataFrame([(10, "F"), (20, "X"), (30, "M"), (40, "M")], schemas.PATIENTS)
    rows = clinical.admission_stays(admissions, diagnoses, procedures, stays, patients)
    got = sorted((r.hadm_id, r.icu_los, r.gender, sorted(r.diagnoses)) for r in rows.collect())
    assert got == [(1, 2, 0, ["4019", "I10"]), (2, 1, None, ["V30"]), (2, 4, None, ["V30"])]
    items = {tuple(r["items"]) for r in clinical.stay_transactions(rows).collect()}
    assert (
        "admission_type=URGENT", "diagnose=4019", "diagnose=I10", "gender=female", "insurance=Medicare", "procedure=9904",
    ) in items


def test_second_database(spark):
    def patient(key, **changes):
        row = dict(
            gender="Male", source="ICU", admit=-100, discharge=1341, status="Alive", age="40", uid=f"u{key}"
        )
        row.update(changes)
        return (key, row["gender"], row["source"], row["admit"], row["discharge"], row["status"], row["age"], row["uid"])

    patients = spark.createDataFrame(
        [
            patient(1), patient(2, age="> 89", gender="Female", source="PACU"), patient(3, age="17"),
            patient(4, status="Expired"), patient(5, gender="Unknown"), patient(6, source="Mars"),
            patient(7, discharge=-3000), patient(8, source=None),
        ],
        schemas.UNIT_PATIENTS,
    )
    got = {r.patientunitstayid: r for r in clinical.unit_patients(patients).collect()}
    assert set(got) == {1, 2, 6}
    assert (got[1].icu_los, got[1].gender, got[1].admission_type, got[1].admission_type_id) == (2, 1, "URGENT", 9)
    assert (got[2].gender, got[2].admission_type_id) == (0, 8)
    assert got[6].admission_type is None and got[6].admission_type_id is None
    lists = spark.createDataFrame(
        [(1, "401.9, I10"), (1, "401.9"), (2, "V30.0"), (2, None), (6, " 250.00 ,E11.9")], schemas.UNIT_DIAGNOSES
    )
    codes = {k: sorted((r[0], r[1]) for r in clinical.code_rows(lists, k).collect()) for k in ("icd9", "icd10")}
    assert codes == {"icd9": [(1, "4019"), (6, "25000")], "icd10": [(1, "I10"), (2, "V300"), (6, "E119")]}
    joined = clinical.unit_diagnoses(patients, lists, "icd9")
    assert sorted(r.patientunitstayid for r in joined.collect()) == [1, 6]
    assert clinical.unit_stays(patients, lists, "icd10").count() == 3


def test_flat_tables(spark):
    rows = spark.createDataFrame(
        [("a", None, 1, "Yes"), ("b", "u", 2, "Yes"), ("c", "v", 3, "No")], "x string, y string, tenure int, churn string"
    )
    kept = flat.clean_flat(rows, F.col("churn") == "Yes", ["churn"])
    assert [tuple(r) for r in flat.tag_columns(kept, "tenure").collect()] == [("b_x", "u_y", 2)]
    kept = flat.clean_flat(rows, F.col("churn") == "Yes", ["churn"], nulls="columns")
    assert kept.columns == ["x", "tenure"] and kept.count() == 2
    got = {tuple(r["items"]) for r in flat.flat_to_transactions(kept, "tenure").collect()}
    assert got == {("a_x",), ("b_x",)}
    with pytest.raises(ValueError):
        flat.clean_flat(rows, F.lit(True), [], nulls="cells")


def test_profile(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "x string, n int")
    shares = {r.category: (r.n, r.percent) for r in profile.category_shares(rows, ["x"]).collect()}
    assert shares == {"a": (2, 50.0), "b": (1, 25.0)}
    eighths = spark.createDataFrame([("a",)] * 1 + [("b",)] * 7, "x string")
    assert {r.category: r.percent for r in profile.category_shares(eighths, ["x"]).collect()} == {"a": 12.0, "b": 88.0}
    assert profile.distinct_counts(rows, ["x", "n"]).first().asDict() == {"n_x": 2, "n_n": 4}
    events = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (2, 9)], "k int, t int")
    assert sorted(tuple(r) for r in profile.earliest_records(events, "k", "t").select("k", "t").collect()) == [
        (1, 3), (1, 3), (2, 9),
    ]
    sets = profile.long_to_sets(events, "k", ["t"], ["t"])
    assert {r[0]: list(r[1]) for r in sets.collect()} == {1: [3, 5], 2: [9]}


def test_dictionary_and_decoding(spark):
    codes = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "code string")
    numbered = dictionary.build_dictionary(codes, "code", "code_id")
    assert {r.code: r.code_id for r in numbered.collect()} == {"a": 1, "b": 2}
    assert sorted(r.code_id for r in dictionary.encode_column(codes, numbered, "code").collect()) == [1, 2, 2]
    table = dictionary.item_dictionary({"diagnose": numbered.select("code_id", "code")})
    rules = spark.createDataFrame([(1, ["20002", "1"]), (2, ["0"])], "set_id int, items array<string>")
    decoded = dictionary.decode_items(rules, table, "set_id", "items").collect()
    assert {r.set_id: r.itemset for r in decoded} == {1: ["b_diagnose", "male"], 2: ["female"]}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_earliest_records_read_once(spark):
    """A task sends only what may be earliest; ties stay, unknown keys and times do not."""
    rows = [(1, 5, "a"), (1, 3, "b"), (1, 3, "c"), (1, None, "d"), (None, 1, "e"), (2, 9, "f"), (3, None, "g")]
    rows += [(4, 10 + n, f"late{n}") for n in range(500)] + [(4, 10, "tie"), (4, 10, "tie")]
    events = spark.createDataFrame(rows, "k int, t int, name string").repartition(7, "name")
    first = profile.earliest_records(events.select("name", "k", "t"), "k", "t")
    assert "Join" not in plan(first) and plan(first).count("WindowGroupLimit") == 2  # before and after the shuffle
    assert first.columns == ["k", "t", "name"]
    assert sorted(tuple(r) for r in first.collect()) == [
        (1, 3, "b"), (1, 3, "c"), (2, 9, "f"), (4, 10, "late0"), (4, 10, "tie"), (4, 10, "tie"),
    ]


def test_sets_are_encoded_inside_their_rows(spark, monkeypatch):
    codes = spark.createDataFrame([(f"c{n}",) for n in range(150)], "code string")
    numbered = dictionary.build_dictionary(codes, "code", "code_id").select("code_id", "code")
    rows = spark.createDataFrame(
        [(1, 2, ["c7", "c0", None, "c7", "?"], "x"), (1, 3, ["c7"], "x"), (1, 3, ["c7"], "y"), (2, None, ["c1"], "x"),
         (None, 1, ["c1"], "x"), (3, 1, [], "x"), (4, 1, None, "x"), (5, 1, ["?", None], "x"), (6, 1, [f"c{n}" for n in range(150)], "x")],
        "a int, b int, codes array<string>, more string",
    )
    ids = {r.code: r.code_id for r in numbered.collect()}
    wanted = [(1, 2, "x", [ids["c0"], ids["c7"]]), (1, 3, "x", [ids["c7"]]), (1, 3, "y", [ids["c7"]]), (6, 1, "x", sorted(ids.values()))]
    for small in (True, False):
        if not small:
            monkeypatch.setattr(dictionary, "LITERAL_ITEMS", 149)
        encoded = dictionary.encode_sets(rows, numbered, "codes", ["a", "b"], "ids")
        assert sorted((r.a, r.b, r.more, sorted(r.ids)) for r in encoded.collect()) == [(a, b, m, sorted(i)) for a, b, m, i in wanted]
        assert ("Exchange" in plan(encoded)) != small
    none = dictionary.encode_sets(rows, numbered.limit(0), "codes", ["a", "b"], "ids")
    assert none.count() == 0


def test_rule_and_code_text(spark):
    rules = spark.createDataFrame([(["diagnose=40199", "gender=male", "x y"], 2.1)], "itemset array<string>, mean double")
    row = rules.select(
        F.transform("itemset", text.plain_item).alias("plain"),
        text.rule_text().alias("rule"),
        text.rule_text(style="latex").alias("latex"),
    ).first()
    assert row.plain == ["40199_diagnose", "male", "x y"]
    assert row.rule == "diagnose=40199 ∧ gender=male ∧ x y ⇒ 3"
    assert row.latex == r"diagnose=40199 $\wedge$ gender=male $\wedge$ xy $\Rightarrow$ 3"
    items = spark.createDataFrame([(["40199_diagnose", "401_diagnose", "9904_procedure", "male"],)], "i array<string>")
    for depth, first in ((0, "401"), (1, "4019"), (9, "40199")):
        got = items.select(F.transform("i", lambda i: text.shorten_item(i, depth))).first()[0]
        assert got == [f"{first}_diagnose", "401_diagnose", "9904_procedure", "male"]


def test_sketches_of_parts_count_like_a_sketch_of_the_whole(spark):
    rows = spark.range(60_000).selectExpr("id % 20000 AS a", "if(id % 7 = 0, null, cast(id % 50 AS string)) AS b", "cast(null AS string) AS c", "id % 3 AS part")
    names = ["a", "b", "c"]
    whole = {r.column_name: r.estimate for r in profile.sketch_counts(profile.distinct_sketches(rows, names), names).collect()}
    parts = profile.merge_sketches(profile.distinct_sketches(rows, names, ["part"]), names)
    merged = {r.column_name: r.estimate for r in profile.sketch_counts(parts, names).collect()}
    exact = profile.distinct_counts(rows, names).first()
    for got in (whole, merged):
        assert got["c"] == 0 and got["b"] == exact.n_b == 50
        assert abs(got["a"] - exact.n_a) <= 4 * profile.sketch_error() * exact.n_a
    nothing = profile.sketch_counts(profile.distinct_sketches(rows.limit(0), names), names)
    assert {r.estimate for r in nothing.collect()} == {0}
