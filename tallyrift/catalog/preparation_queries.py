"""Preparing raw tables, and the rules mined from what comes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyrift.catalog import bindings as b
from tallyrift.catalog import clinical_bindings as c
from tallyrift.catalog import sql
from tallyrift.catalog.mining_queries import rules_sql
from tallyrift.catalog.registry import num, query, show_rules
from tallyrift.operators import dictionary, profile
from tallyrift.operators.transactions import keep_marked_items
from tallyrift.plans import clinical, flat
from tallyrift.plans.discovery import discover_rules, score_rules, split_population
from tallyrift.session import materialize


def joined(column: str):
    return F.array_join(F.array_sort(column), ",").alias(column)


def known(column: str):
    """-1 for null: not every comparison keeps integers integers next to nulls."""
    return F.coalesce(column, F.lit(-1)).alias(column)


def case_sql(column: str, table: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items())
    return f"CASE {column} {whens} END"


ADMISSIONS = """admissions AS (SELECT o_orderkey AS hadm_id, o_orderpriority AS admission_type,
  'Plan ' || (o_custkey % 3) AS insurance FROM orders WHERE o_orderstatus <> 'P'),
line_parts AS (SELECT l_orderkey AS hadm_id, l_returnflag, p_brand, p_type, p_size
  FROM lineitem JOIN part ON l_partkey = p_partkey),
dia AS (SELECT hadm_id, list_sort(list(DISTINCT replace(p_brand, 'Brand#', '40'))) AS codes FROM line_parts GROUP BY hadm_id),
pro AS (SELECT hadm_id, list_sort(list(DISTINCT p_type)) AS codes FROM line_parts WHERE l_returnflag <> 'N' GROUP BY hadm_id),
stays AS (SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_quantity / 4 AS los,
  l_shipdate = min(l_shipdate) OVER (PARTITION BY l_orderkey) AS earliest
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
base AS (SELECT DISTINCT a.hadm_id, CAST(floor(los) AS BIGINT) AS icu_los,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 0 WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 1 END AS gender,
  admission_type, insurance
  FROM stays JOIN customer ON subject_id = c_custkey JOIN admissions a ON a.hadm_id = stays.hadm_id WHERE earliest),
prepared AS (SELECT base.*, dia.codes AS diagnoses, pro.codes AS procedures
  FROM base JOIN dia ON dia.hadm_id = base.hadm_id JOIN pro ON pro.hadm_id = base.hadm_id)"""

ADMISSION_TX = ADMISSIONS + """,
tx AS (SELECT row_number() OVER () AS tid, list_concat(
    CASE gender WHEN 0 THEN ['gender=female'] WHEN 1 THEN ['gender=male'] ELSE [] END,
    list_concat(['admission_type=' || admission_type, 'insurance=' || insurance], list_concat(
    list_transform(diagnoses, lambda d: 'diagnose=' || d), list_transform(procedures, lambda d: 'procedure=' || d)))) AS items,
  icu_los AS target, 1 AS weight FROM prepared)"""


@query(
    "admission_stays",
    sql.query(
        ADMISSIONS,
        select="SELECT hadm_id, icu_los, coalesce(gender, -1) AS gender, admission_type, insurance, array_to_string(diagnoses, ',') AS diagnoses, "
        "array_to_string(procedures, ',') AS procedures FROM prepared",
    ),
)
def admission_stays(spark, folder):
    stays = clinical.admission_stays(*c.first_database(spark, folder))
    return stays.select(
        "hadm_id", "icu_los", known("gender"), "admission_type", "insurance", joined("diagnoses"), joined("procedures")
    )


def admission_transactions(spark, folder):
    return clinical.stay_transactions(clinical.admission_stays(*c.first_database(spark, folder)))


MINED_ADMISSIONS = sql.mined(ADMISSION_TX, 0.05, 6)


@query("kl_rules_admissions", rules_sql(MINED_ADMISSIONS, sql.KL))
def kl_rules_admissions(spark, folder):
    return show_rules(discover_rules(admission_transactions(spark, folder), 0.05, "kl"))


@query(
    "expo_rules_admissions",
    rules_sql(
        MINED_ADMISSIONS, sql.EXPO, "fit_set <= 0.35 AND fit_counter <= 0.35",
        f", {sql.num('fit_set', 'fit_set')}, {sql.num('fit_counter', 'fit_counter')}",
    ),
)
def expo_rules_admissions(spark, folder):
    rules = discover_rules(admission_transactions(spark, folder), 0.05, "expo", fit_threshold=0.35)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query("mean_rules_admissions", rules_sql(MINED_ADMISSIONS, sql.MEAN, "TRUE", f", {sql.num('z', 'z')}"))
def mean_rules_admissions(spark, folder):
    return show_rules(discover_rules(admission_transactions(spark, folder), 0.05, "mean"), num("z"))


@query(
    "decoded_rules",
    sql.query(
        MINED_ADMISSIONS, sql.histogram(), sql.KL,
        """plain AS (SELECT freq, mean, score, list_sort(list_transform(s, lambda i: CASE
    WHEN starts_with(i, 'diagnose=') THEN split_part(i, '=', 2) || '_diagnose'
    WHEN starts_with(i, 'procedure=') THEN split_part(i, '=', 2) || '_procedure' ELSE split_part(i, '=', 2) END)) AS s FROM scored)""",
        select=f"SELECT {sql.text()}, freq, {sql.num('mean', 'mean')}, {sql.num('score', 'score')} FROM plain",
    ),
)
def decoded_rules(spark, folder):
    """Dictionaries, integer items in offset ranges, and decoding of all rules."""
    transactions, items = clinical.prepare_admissions(*c.first_database(spark, folder))
    split = split_population(transactions, 0.05, store=False)
    scored = materialize(score_rules(split, "kl").withColumnRenamed("itemset", "items"), "scored")
    decoded = dictionary.decode_items(scored, items, "set_id", "items")
    return decoded.select(F.array_join("itemset", "|").alias("itemset"), "freq", num("mean"), num("score"))


@query(
    "admission_shares",
    sql.query(
        ADMISSIONS,
        "d AS (SELECT DISTINCT hadm_id, insurance, admission_type, gender FROM prepared)",
        """long AS (SELECT 'insurance' AS column_name, insurance AS category FROM d UNION ALL
  SELECT 'admission_type', admission_type FROM d UNION ALL SELECT 'gender', CAST(gender AS VARCHAR) FROM d)""",
        select="""SELECT column_name, category, count(*) AS n,
  round_even(count(*) * 100.0 / (SELECT count(*) FROM d), 0) + 0.0 AS percent
FROM long WHERE category IS NOT NULL GROUP BY column_name, category""",
    ),
)
def admission_shares(spark, folder):
    columns = ["insurance", "admission_type", "gender"]
    stays = clinical.admission_stays(*c.first_database(spark, folder)).select("hadm_id", *columns).distinct()
    return profile.category_shares(stays, columns)


UNIT = f"""patient AS (SELECT o_orderkey AS id, o_custkey, o_totalprice, o_orderpriority, o_orderstatus,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'HOUSEHOLD' THEN 0 WHEN 'FURNITURE' THEN NULL ELSE 1 END AS gender,
  ['{"', '".join(c.SOURCES)}'][CAST(o_custkey % 16 AS INTEGER) + 1] AS source,
  CAST(ceil((CAST(floor(o_totalprice / 40) AS BIGINT) - 1000 + 600) / 1440) AS BIGINT) AS icu_los,
  CASE WHEN floor(c_acctbal / 100) > 89 THEN 90 ELSE CAST(floor(c_acctbal / 100) AS INTEGER) END AS age
  FROM orders JOIN customer ON o_custkey = c_custkey),
kept AS (SELECT id AS patientunitstayid, 'u' || o_custkey AS uniquepid, gender,
  {case_sql('source', clinical.ADMISSION_TYPE_OF_SOURCE)} AS admission_type, icu_los
  FROM patient WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND age >= 18 AND icu_los >= 0
  AND gender IS NOT NULL),
units AS (SELECT *, {case_sql('admission_type', clinical.ADMISSION_TYPE_IDS)} AS admission_type_id FROM kept)"""

CODES = """parts AS (SELECT l_orderkey AS id, l_returnflag AS f, replace(p_brand, 'Brand#', '') AS br, p_size % 7 AS z,
  left(p_type, 1) AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
lists AS (SELECT id, CASE f WHEN 'R' THEN '40' || z || '.' || br || ', I' || lpad(br, 2, '0') || '.' || t
  WHEN 'A' THEN 'I' || lpad(br, 2, '0') || '.' || t || ' ' END AS codes FROM parts),
single AS (SELECT id, trim(unnest(string_split(codes, ','))) AS code FROM lists WHERE codes IS NOT NULL),
coded AS (SELECT DISTINCT id, replace(code, '.', '') AS icd_code,
  CASE WHEN regexp_matches(code, '^[0-9]') THEN 'icd9' ELSE 'icd10' END AS code_type FROM single)"""


@query("mapped_values", sql.query(UNIT, select="SELECT * REPLACE (coalesce(admission_type_id, -1) AS admission_type_id) FROM units"))
def mapped_values(spark, folder):
    patients = clinical.unit_patients(c.unit_patient(spark, folder))
    return patients.withColumn("admission_type_id", known("admission_type_id"))


@query(
    "split_codes",
    sql.query(CODES, select="SELECT id AS patientunitstayid, icd_code, code_type FROM coded"),
)
def split_codes(spark, folder):
    return clinical.all_codes(c.unit_diagnosis(spark, folder))


@query(
    "unit_diagnoses",
    sql.query(
        UNIT, CODES,
        select="SELECT u.* REPLACE (coalesce(admission_type_id, -1) AS admission_type_id), icd_code, code_type FROM units u JOIN coded ON coded.id = u.patientunitstayid",
    ),
)
def unit_diagnoses(spark, folder):
    rows = clinical.unit_diagnoses(c.unit_patient(spark, folder), c.unit_diagnosis(spark, folder))
    return rows.withColumn("admission_type_id", known("admission_type_id"))


@query(
    "unit_code_dictionary",
    sql.query(
        UNIT, CODES,
        select="""SELECT code_type, CAST(row_number() OVER (PARTITION BY code_type ORDER BY icd_code) AS INTEGER) AS code_id, icd_code
FROM (SELECT DISTINCT code_type, icd_code FROM units u JOIN coded ON coded.id = u.patientunitstayid) d""",
    ),
)
def unit_code_dictionary(spark, folder):
    return clinical.prepare_units(c.unit_patient(spark, folder), c.unit_diagnosis(spark, folder))[1]


@query(
    "text_times",
    """SELECT o_custkey AS customer, min(strptime(t, '%Y-%m-%d %H:%M:%S')) AS first_time, count(*) AS n
FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') || ' 0' || (o_orderkey % 10) || ':30:00' AS t FROM orders) o GROUP BY o_custkey""",
)
def text_times(spark, folder):
    """Timestamps written as text, parsed, and the earliest per customer."""
    orders = b.table(spark, folder, "orders")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 0"), F.col("o_orderkey") % 10, F.lit(":30:00"))
    times = clinical.parsed_times(orders.select(F.col("o_custkey").alias("customer"), text.alias("t")), ["t"])
    return times.groupBy("customer").agg(F.min("t").alias("first_time"), F.count(F.lit(1)).alias("n"))


@query(
    "distinct_counts",
    sql.query(
        UNIT, CODES,
        select="""SELECT count(DISTINCT patientunitstayid) AS n_patientunitstayid, count(DISTINCT uniquepid) AS n_uniquepid
FROM units JOIN coded ON coded.id = units.patientunitstayid WHERE code_type = 'icd10'""",
    ),
)
def distinct_counts(spark, folder):
    rows = clinical.unit_diagnoses(c.unit_patient(spark, folder), c.unit_diagnosis(spark, folder), "icd10")
    return profile.distinct_counts(rows, ["patientunitstayid", "uniquepid"])


SKETCHED = ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")


@query(
    "distinct_sketches_agree",
    "\nUNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n, true AS agrees FROM lineitem" for c in SKETCHED),
)
def distinct_sketches_agree(spark, folder):
    """Sketches per line number, merged, against exact counts: within four standard errors."""
    lines = b.table(spark, folder, "lineitem")
    parts = materialize(profile.distinct_sketches(lines.withColumn("part", F.col("l_linenumber")), SKETCHED, ["part"]), "sketches")
    estimates = profile.sketch_counts(profile.merge_sketches(parts, SKETCHED), SKETCHED)
    exact = profile.distinct_counts(lines, SKETCHED)
    exact = exact.select(*[F.col(f"n_{c}").alias(c) for c in SKETCHED]).unpivot([], list(SKETCHED), "column_name", "n")
    near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * 4 * profile.sketch_error())
    return exact.join(estimates, "column_name").select("column_name", "n", near.alias("agrees"))


def unit_tx(kind: str) -> str:
    return f"""{UNIT},
{CODES},
sets AS (SELECT id, list('diagnose=' || icd_code) AS codes FROM coded WHERE code_type = '{kind}' GROUP BY id),
tx AS (SELECT patientunitstayid AS tid, list_concat(
    list_concat([CASE gender WHEN 0 THEN 'gender=female' ELSE 'gender=male' END],
    CASE WHEN admission_type IS NULL THEN [] ELSE ['admission_type=' || admission_type] END), codes) AS items,
  icu_los AS target, 1 AS weight FROM units JOIN sets ON sets.id = units.patientunitstayid)"""


@query("kl_rules_unit_icd9", rules_sql(sql.mined(unit_tx("icd9"), 0.025, 5), sql.KL))
def kl_rules_unit_icd9(spark, folder):
    return show_rules(discover_rules(unit_transactions(spark, folder, "icd9"), 0.025, "kl"))


@query("mean_rules_unit_icd10", rules_sql(sql.mined(unit_tx("icd10"), 0.025, 5), sql.MEAN, "TRUE", f", {sql.num('z', 'z')}"))
def mean_rules_unit_icd10(spark, folder):
    return show_rules(discover_rules(unit_transactions(spark, folder, "icd10"), 0.025, "mean"), num("z"))


def unit_transactions(spark, folder, kind):
    stays = clinical.unit_stays(c.unit_patient(spark, folder), c.unit_diagnosis(spark, folder), kind)
    return clinical.stay_transactions(stays)


FITS = f", {sql.num('fit_set', 'fit_set')}, {sql.num('fit_counter', 'fit_counter')}"


@query("expo_rules_unit_icd9", rules_sql(sql.mined(unit_tx("icd9"), 0.025, 5), sql.EXPO, "fit_set <= 0.4 AND fit_counter <= 0.4", FITS))
def expo_rules_unit_icd9(spark, folder):
    rules = discover_rules(unit_transactions(spark, folder, "icd9"), 0.025, "expo", fit_threshold=0.4)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query("kl_rules_unit_icd10", rules_sql(sql.mined(unit_tx("icd10"), 0.025, 5), sql.KL))
def kl_rules_unit_icd10(spark, folder):
    return show_rules(discover_rules(unit_transactions(spark, folder, "icd10"), 0.025, "kl"))


@query("expo_rules_unit_icd10", rules_sql(sql.mined(unit_tx("icd10"), 0.025, 5), sql.EXPO, "fit_set <= 0.4 AND fit_counter <= 0.4", FITS))
def expo_rules_unit_icd10(spark, folder):
    rules = discover_rules(unit_transactions(spark, folder, "icd10"), 0.025, "expo", fit_threshold=0.4)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query(
    "stay_histogram",
    sql.query(
        ADMISSIONS,
        select="SELECT icu_los AS target, count(*) AS n FROM (SELECT DISTINCT hadm_id, icu_los FROM prepared) d GROUP BY icu_los",
    ),
)
def stay_histogram(spark, folder):
    stays = clinical.admission_stays(*c.first_database(spark, folder)).select("hadm_id", "icu_los").distinct()
    return stays.groupBy(F.col("icu_los").alias("target")).agg(F.count(F.lit(1)).alias("n"))


# flat tables -------------------------------------------------------------------------------------


def contract_rows(spark, folder, gaps=False):
    """Order lines as contracts: one categorical column per attribute, a closed flag.
    With ``gaps`` the largest lines have no status."""
    status = F.when(F.col("l_quantity") < 49, F.col("l_linestatus")) if gaps else F.col("l_linestatus")
    return b.flat_rows(spark, folder).select(
        *b.FLAT_ITEMS[:3],
        status.alias("status"),
        F.col("l_returnflag").alias("closed"),
        F.col("l_quantity").cast("int").alias("tenure"),
        F.col("o_custkey").alias("customer"),
    )


def contracts(spark, folder, gaps=False):
    return flat.clean_flat(contract_rows(spark, folder, gaps), F.col("closed") == "R", ["customer", "closed"])


TAGGED = """contracts AS (SELECT c_mktsegment || '_c_mktsegment' AS c_mktsegment, o_orderstatus || '_o_orderstatus' AS o_orderstatus,
  o_orderpriority || '_o_orderpriority' AS o_orderpriority, l_linestatus || '_status' AS status,
  CAST(l_quantity AS INTEGER) AS tenure
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE l_returnflag = 'R')"""
TAGGED_TX = TAGGED + """,
counted AS (SELECT *, count(*) AS weight FROM contracts GROUP BY ALL),
tx AS (SELECT row_number() OVER () AS tid, [c_mktsegment, o_orderstatus, o_orderpriority, status] AS items,
  CAST(tenure AS BIGINT) AS target, weight FROM counted)"""


@query("tagged_rows", sql.query(TAGGED, select="SELECT * FROM contracts WHERE tenure < 49"))
def tagged_rows(spark, folder):
    return flat.tag_columns(contracts(spark, folder, gaps=True), "tenure")


@query("kl_rules_tagged", rules_sql(sql.mined(TAGGED_TX, 0.05, 4), sql.KL))
def kl_rules_tagged(spark, folder):
    return show_rules(discover_rules(flat.flat_to_transactions(contracts(spark, folder), "tenure"), 0.05, "kl"))


TAGGED_MINED = sql.mined(TAGGED_TX, 0.05, 4)


@query("expo_rules_tagged", rules_sql(TAGGED_MINED, sql.EXPO, "fit_set <= 0.35 AND fit_counter <= 0.35", FITS))
def expo_rules_tagged(spark, folder):
    transactions = flat.flat_to_transactions(contracts(spark, folder), "tenure")
    rules = discover_rules(transactions, 0.05, "expo", fit_threshold=0.35)
    return show_rules(rules, num("fit_set"), num("fit_counter"))


@query("mean_rules_tagged", rules_sql(TAGGED_MINED, sql.MEAN, "TRUE", f", {sql.num('z', 'z')}"))
def mean_rules_tagged(spark, folder):
    return show_rules(discover_rules(flat.flat_to_transactions(contracts(spark, folder), "tenure"), 0.05, "mean"), num("z"))


@query(
    "marked_items",
    sql.query(
        TAGGED,
        select="SELECT c_mktsegment || '|' || o_orderstatus || '|' || o_orderpriority || '|' || status AS items, "
        "tenure, count(*) AS n FROM contracts GROUP BY ALL",
    ),
)
def marked_items(spark, folder):
    """All columns of a tagged row as one array, then only the marked ones."""
    rows = flat.tag_columns(contracts(spark, folder), "tenure")
    whole = F.array(*[F.col(column).cast("string") for column in rows.columns])
    items = F.array_join(keep_marked_items(whole), "|").alias("items")
    return rows.select(items, "tenure").groupBy("items", "tenure").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_share",
    sql.query(
        TAGGED,
        """long AS (SELECT unnest(['c_mktsegment', 'o_orderstatus', 'o_orderpriority', 'status']) AS column_name,
  unnest([c_mktsegment, o_orderstatus, o_orderpriority, status]) AS category FROM contracts)""",
        select="""SELECT column_name, category, count(*) AS n,
  round_even(count(*) * 100.0 / (SELECT count(*) FROM contracts), 0) + 0.0 AS percent
FROM long GROUP BY column_name, category""",
    ),
)
def category_share(spark, folder):
    rows = flat.tag_columns(contracts(spark, folder), "tenure")
    return profile.category_shares(rows, [column for column in rows.columns if column != "tenure"])


@query(
    "null_column_drop",
    """SELECT c_mktsegment || '_c_mktsegment' AS c_mktsegment, (c_nationkey % 5) || '_area' AS area,
  CAST(floor(c_acctbal / 100) AS BIGINT) AS credit FROM customer WHERE c_custkey % 3 <> 0""",
)
def null_column_drop(spark, folder):
    customers = b.table(spark, folder, "customer").select(
        "c_mktsegment",
        (F.col("c_nationkey") % 5).alias("area"),
        F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("in_credit"),
        F.floor(F.col("c_acctbal") / 100).alias("credit"),
        (F.col("c_custkey") % 3).alias("left"),
    )
    return flat.tag_columns(flat.clean_flat(customers, F.col("left") != 0, ["left"], nulls="columns"), "credit")


# single operators --------------------------------------------------------------------------------


@query(
    "first_event_per_key",
    """SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events
QUALIFY events.ts = min(events.ts) OVER (PARTITION BY user_id)""",
)
def first_event_per_key(spark, folder):
    events = b.table(spark, folder, "events").select("user_id", "event_id", "ts")
    first = profile.earliest_records(events, "user_id", "ts")
    return first.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query(
    "earliest_lines",
    """SELECT l_orderkey, l_linenumber FROM lineitem
QUALIFY l_shipdate = min(l_shipdate) OVER (PARTITION BY l_orderkey)""",
)
def earliest_lines(spark, folder):
    lines = b.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return profile.earliest_records(lines, "l_orderkey", "l_shipdate").select("l_orderkey", "l_linenumber")


@query(
    "dictionary_ids",
    """WITH d AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS name_id FROM (SELECT DISTINCT p_name FROM part) u)
SELECT p_partkey, CAST(name_id AS INTEGER) AS name_id FROM part JOIN d ON d.p_name = part.p_name""",
)
def dictionary_ids(spark, folder):
    parts = b.table(spark, folder, "part").select("p_partkey", "p_name")
    return dictionary.encode_column(parts, dictionary.build_dictionary(parts, "p_name", "name_id"), "p_name")


@query(
    "long_to_sets",
    """SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS l_returnflag,
  array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS l_linestatus, min(l_suppkey) AS l_suppkey
FROM lineitem GROUP BY l_orderkey""",
)
def long_to_sets(spark, folder):
    lines = b.table(spark, folder, "lineitem")
    sets = profile.long_to_sets(lines, "l_orderkey", ["l_returnflag", "l_linestatus"], ["l_suppkey"])
    return sets.select("l_orderkey", joined("l_returnflag"), joined("l_linestatus"), "l_suppkey")
