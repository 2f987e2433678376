"""Rule sets of two databases, their exchange and their comparison."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import functions as F

from tallyrift.catalog import bindings as b
from tallyrift.catalog import sql
from tallyrift.catalog.mining_queries import BASKETS, EVENTS, FLAT
from tallyrift.catalog.preparation_queries import MINED_ADMISSIONS, admission_transactions
from tallyrift.catalog.registry import num, query, text
from tallyrift.functions.text import plain_item
from tallyrift.operators.matching import RuleSet, best_percent, match, match_rate, merge, roll_up
from tallyrift.operators.rollup import roll_up_all
from tallyrift.plans.comparison import match_sweep, rules_at, score_all, sweep_rates, sweep_summary
from tallyrift.plans.discovery import discover_rules, split_population
from tallyrift.session import shared_folder
from tallyrift.sources import exchange, rule_stream, tables

URGENT = ("1-URGENT", "2-HIGH")
CUT = "1996-01-01"
SWEEP = (0.05, 0.075)
RATES = (0.05, 0.06, 0.075)
PERCENTS = (40, 100)

# The first database holds the orders before the cut, the second the later ones,
# the urgent and the other orders of it mined apart (as two code systems would be).
SIDES = {
    "l": f"o_orderdate < TIMESTAMP '{CUT}'",
    "a": f"o_orderdate >= TIMESTAMP '{CUT}' AND o_orderpriority IN {URGENT}",
    "b": f"o_orderdate >= TIMESTAMP '{CUT}' AND o_orderpriority NOT IN {URGENT}",
}


def sides(spark, folder, min_support, which=("l", "a", "b")):
    orders = b.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    early, urgent = F.col("o_orderdate") < F.lit(CUT), F.col("o_orderpriority").isin(*URGENT)
    wanted = {"l": early, "a": ~early & urgent, "b": ~early & ~urgent}
    facts = b.basket_facts(spark, folder)

    def split(side):
        mine = facts.join(orders.filter(wanted[side]), F.col("l_orderkey") == F.col("o_orderkey"))
        return split_population(b.basket_transactions(mine), min_support)

    with ThreadPoolExecutor(len(which)) as pool:  # the databases are independent
        return list(pool.map(split, which))


def side_sql(p: str, min_support: float) -> str:
    """CTE ``{p}rules(s, score, freq, rn, cnt)`` and everything below it."""
    tx = f"""{p}tx AS (
  SELECT l_orderkey AS tid,
         list_concat(list(DISTINCT 'brand=' || p_brand), list(DISTINCT 'type=' || p_type)) AS items,
         CAST(sum(l_quantity) AS BIGINT) AS target, 1 AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE {SIDES[p[0]]} GROUP BY l_orderkey)"""
    return ",\n".join([
        sql.mined(tx, min_support, 5, p),
        sql.histogram(p),
        f"{p}sizes AS (SELECT s, freq, sum(n_counter) AS n_counter FROM {p}hist GROUP BY s, freq)",
        f"""{p}rules AS MATERIALIZED (SELECT s, freq, score, row_number() OVER (ORDER BY round(score, 12) DESC, s) AS rn,
  count(*) OVER () AS cnt FROM (SELECT z.s, z.freq,
    coalesce(sum(CASE WHEN h.n_set > 0 AND h.n_counter > 0 THEN (h.n_counter / z.n_counter)
      * ln((h.n_counter / z.n_counter) / (h.n_set / z.freq)) END), 0) AS score
  FROM {p}sizes z JOIN {p}hist h ON h.s = z.s WHERE z.n_counter > 0 GROUP BY z.s, z.freq, z.n_counter) u)""",
    ])


def matched_sql(percent: float, l: str = "l_", a: str = "a_", c: str = "b_", out: str = "") -> str:
    """CTE ``{out}matched(s, left_score, right_score, divergence)``."""
    keep = f"rn <= floor(cnt * ({percent} / 100.0::DOUBLE))"
    return f"""{out}best AS (SELECT * FROM {l}rules WHERE {keep}),
{out}besta AS (SELECT * FROM {a}rules WHERE {keep}),
{out}bestb AS (SELECT * FROM {c}rules WHERE {keep}),
{out}merged AS (SELECT s, score, freq, 'b' AS origin FROM {out}bestb UNION ALL
  SELECT s, score, freq, 'a' FROM {out}besta WHERE s NOT IN (SELECT s FROM {out}bestb)),
{out}mv AS (SELECT m.s, i.target, i.n_set, m.freq FROM {out}merged m JOIN {c}inside i ON i.s = m.s WHERE m.origin = 'b'
  UNION ALL SELECT m.s, i.target, i.n_set, m.freq FROM {out}merged m JOIN {a}inside i ON i.s = m.s WHERE m.origin = 'a'),
{out}lv AS (SELECT r.s, i.target, i.n_set, r.freq FROM {out}best r JOIN {l}inside i ON i.s = r.s),
{out}al AS (SELECT coalesce(x.s, y.s) AS s, coalesce(x.n_set / x.freq, 0) AS p, coalesce(y.n_set / y.freq, 0) AS q
  FROM {out}lv x FULL OUTER JOIN {out}mv y ON x.s = y.s AND x.target = y.target),
{out}matched AS (SELECT t.s, any_value(t.score) AS left_score, any_value(m.score) AS right_score,
  0.5 * (sum(CASE WHEN p > 0 THEN (p + 1e-10) * ln((p + 1e-10) / (q + 1e-10)) ELSE 0 END)
       + sum(CASE WHEN q > 0 THEN (q + 1e-10) * ln((q + 1e-10) / (p + 1e-10)) ELSE 0 END)) AS divergence
  FROM {out}best t JOIN {out}merged m ON m.s = t.s JOIN {out}al a ON a.s = t.s GROUP BY t.s)"""


@query(
    "rules_top_percent",
    sql.query(
        side_sql("l_", 0.05),
        select=f"SELECT {sql.text()}, {sql.num('score', 'score')} FROM l_rules WHERE rn <= floor(cnt * 0.4::DOUBLE)",
    ),
)
def rules_top_percent(spark, folder):
    (left,) = sides(spark, folder, 0.05, "l")
    return best_percent(rules_at(left, 0.05), 40).rules.select(text(), num("score"))


THREE = [side_sql(p, 0.05) for p in ("l_", "a_", "b_")]


@query(
    "rules_merged",
    sql.query(
        *THREE, matched_sql(40),
        select=f"SELECT {sql.text()}, {sql.num('score', 'score')}, freq AS support FROM merged",
    ),
)
def rules_merged(spark, folder):
    first, second = (best_percent(rules_at(side, 0.05), 40) for side in sides(spark, folder, 0.05, "ab"))
    merged = merge(first, second)
    support = merged.values.groupBy("itemset").agg(F.sum("n").alias("support"))
    return merged.rules.join(support, "itemset").select(text(), num("score"), "support")


@query(
    "rules_matched",
    sql.query(
        *THREE, matched_sql(100),
        select=f"""SELECT {sql.text()}, {sql.num('left_score', 'left_score')}, {sql.num('right_score', 'right_score')},
  {sql.num('divergence', 'divergence')} FROM matched""",
    ),
)
def rules_matched(spark, folder):
    left, first, second = (rules_at(side, 0.05) for side in sides(spark, folder, 0.05))
    matched = match(left, merge(first, second))
    return matched.select(text(), num("left_score"), num("right_score"), num("divergence"))


@query(
    "match_rate",
    sql.query(
        *THREE, matched_sql(100),
        """sizes AS (SELECT (SELECT count(*) FROM best) AS n_left, (SELECT count(*) FROM merged) AS n_right,
  (SELECT count(*) FROM matched) AS n_matched)""",
        select=f"SELECT *, {sql.num('n_matched * 100.0 / least(n_left, n_right)', 'match_rate')} FROM sizes",
    ),
)
def match_rate_query(spark, folder):
    left, first, second = (rules_at(side, 0.05) for side in sides(spark, folder, 0.05))
    right = merge(first, second)
    rates = match_rate(left, right, match(left, right))
    return rates.withColumn("match_rate", num("match_rate"))


def _sweep_sql() -> str:
    parts, selects = [], []
    for i, support in enumerate(SWEEP):
        names = [f"{side}{i}_" for side in "lab"]
        parts += [side_sql(name, support) for name in names]
        for percent in PERCENTS:
            out = f"o{i}_{percent}_"
            parts.append(matched_sql(percent, *names, out=out))
            selects.append(
                f"""SELECT CAST({support} AS DOUBLE) AS min_support, {percent} AS percent, count(*) AS n_matched,
  {sql.num('avg(divergence)', 'mean')}, {sql.num('stddev_pop(divergence)', 'sd')} FROM {out}matched HAVING count(*) > 0"""
            )
    return sql.query(*parts, select="\nUNION ALL ".join(selects))


@query("match_summary", _sweep_sql())
def match_summary(spark, folder):
    left, *rights = sides(spark, folder, min(SWEEP))
    summary = sweep_summary(match_sweep(left, rights, SWEEP, PERCENTS))
    return summary.select("min_support", "percent", "n_matched", num("mean"), num("sd"))


def _rates_sql() -> str:
    parts, selects = [], []
    for i, support in enumerate(RATES):
        names = [f"{side}{i}_" for side in "lab"]
        parts += [side_sql(name, support) for name in names]
        for percent in PERCENTS:
            out = f"o{i}_{percent}_"
            parts.append(matched_sql(percent, *names, out=out))
            selects.append(
                f"""SELECT CAST({support} AS DOUBLE) AS min_support, {percent} AS percent, l.n AS n_left, r.n AS n_right, m.n AS n_matched,
  {sql.num('m.n * 100.0 / least(l.n, r.n)', 'match_rate')} FROM (SELECT count(*) AS n FROM {out}best) l,
  (SELECT count(*) AS n FROM {out}merged) r, (SELECT count(*) AS n FROM {out}matched) m WHERE l.n > 0 AND r.n > 0"""
            )
    return sql.query(*parts, select="\nUNION ALL ".join(selects))


@query("match_rates", _rates_sql())
def match_rates(spark, folder):
    left, *rights = sides(spark, folder, min(RATES))
    return sweep_rates(left, rights, RATES, PERCENTS).withColumn("match_rate", num("match_rate"))


def plain_rules(rules: RuleSet) -> RuleSet:
    """Rules with items as they read in text."""
    plain = F.array_sort(F.transform("itemset", plain_item))
    return RuleSet(rules.rules.withColumn("itemset", plain), rules.values.withColumn("itemset", plain))


@query(
    "rules_rolled_up",
    sql.query(
        MINED_ADMISSIONS, sql.histogram(), sql.KL,
        """plain AS (SELECT s, score, row_number() OVER (ORDER BY round(score, 12) DESC, s) AS rn, list_sort(list_transform(s, lambda i: CASE
    WHEN starts_with(i, 'diagnose=') THEN left(split_part(i, '=', 2), 3) || '_diagnose'
    WHEN starts_with(i, 'procedure=') THEN split_part(i, '=', 2) || '_procedure' ELSE split_part(i, '=', 2) END)) AS r FROM scored),
first AS (SELECT r, arg_min(score, rn) AS score FROM plain GROUP BY r),
added AS (SELECT r, target, CAST(sum(n_set) AS BIGINT) AS n FROM plain JOIN inside ON inside.s = plain.s GROUP BY r, target)""",
        select=f"SELECT {sql.text('first.r')}, {sql.num('score', 'score')}, target, n FROM first JOIN added ON added.r = first.r",
    ),
)
def rules_rolled_up(spark, folder):
    rules = rules_at(split_population(admission_transactions(spark, folder), 0.05), 0.05)
    rolled = roll_up(plain_rules(rules), depth=0)
    return rolled.rules.join(rolled.values, "itemset").select(text(), num("score"), "target", "n")


ROLLED_SUPPORTS = (0.05, 0.1)
ROLLED_DEPTHS = (0, 1)


def _rolled_sql() -> str:
    parts, selects = [MINED_ADMISSIONS, sql.histogram(), sql.KL], []
    for depth in ROLLED_DEPTHS:
        for i, support in enumerate(ROLLED_SUPPORTS):
            out = f"o{depth}_{i}_"
            parts.append(
                f"""{out}plain AS (SELECT s, score, row_number() OVER (ORDER BY round(score, 12) DESC, s) AS rn,
  list_sort(list_transform(s, lambda i: CASE
    WHEN starts_with(i, 'diagnose=') THEN left(split_part(i, '=', 2), {3 + depth}) || '_diagnose'
    WHEN starts_with(i, 'procedure=') THEN split_part(i, '=', 2) || '_procedure' ELSE split_part(i, '=', 2) END)) AS r
  FROM scored WHERE freq >= (SELECT ceil(CAST({support} AS DOUBLE) * n) FROM n)),
{out}first AS (SELECT r, arg_min(score, rn) AS score FROM {out}plain GROUP BY r),
{out}added AS (SELECT r, target, CAST(sum(n_set) AS BIGINT) AS n FROM {out}plain p JOIN inside ON inside.s = p.s GROUP BY r, target)"""
            )
            selects.append(
                f"""SELECT {depth} AS depth, CAST({support} AS DOUBLE) AS min_support, {sql.text('f.r')}, {sql.num('score', 'score')},
  count(*) AS n_values, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * target) AS BIGINT) AS total
FROM {out}first f JOIN {out}added a ON a.r = f.r GROUP BY f.r, score"""
            )
    return sql.query(*parts, select="\nUNION ALL ".join(selects))


@query("rules_rolled_up_sweep", _rolled_sql())
def rules_rolled_up_sweep(spark, folder):
    """Shortened rules of every depth and support, from one hierarchy."""
    split = split_population(admission_transactions(spark, folder), min(ROLLED_SUPPORTS))
    plain = split.itemsets.withColumn("itemset", F.array_sort(F.transform("itemset", plain_item)))
    rolled = roll_up_all(replace(split, itemsets=plain), score_all(split).drop("itemset").join(plain.drop("freq"), "set_id"),
                         ROLLED_SUPPORTS, ROLLED_DEPTHS)
    key = ["depth", "min_support", "node"]
    sums = rolled.values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("target")).alias("total")
    )
    return rolled.rules.join(sums, key).select("depth", "min_support", text(), num("score"), "n_values", "n", "total")


EXCHANGED = f"""SELECT {sql.text()}, {sql.num('score', 'score')}, target, n_set AS n
FROM scored JOIN inside ON inside.s = scored.s"""
EXCHANGED = EXCHANGED.replace(sql.text(), sql.text("scored.s"))


def show_exchanged(rules: RuleSet):
    return rules.rules.join(rules.values, "itemset").select(text(), num("score"), "target", "n")


def new_path(spark, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query("rules_text_roundtrip", sql.query(FLAT, sql.histogram(), sql.KL, select=EXCHANGED))
def rules_text_roundtrip(spark, folder):
    path = new_path(spark, "rule-lines")
    exchange.write_rule_lines(rules_at(split_population(b.flat_transactions(spark, folder), 0.05), 0.05), path)
    return show_exchanged(exchange.read_rule_lines(spark, path))


@query("rules_plain_text_roundtrip", sql.query(EVENTS, sql.histogram(), sql.KL, select=EXCHANGED))
def rules_plain_text_roundtrip(spark, folder):
    path = new_path(spark, "rule-lines")
    rules = rules_at(split_population(b.event_transactions(spark, folder), 0.025), 0.025)
    exchange.write_rule_lines(rules, path, counted=False)
    return show_exchanged(exchange.read_rule_lines(spark, path))


@query("rules_stream_roundtrip", sql.query(EVENTS, sql.histogram(), sql.KL, select=EXCHANGED))
def rules_stream_roundtrip(spark, folder):
    path = new_path(spark, "rule-stream")
    rules = rules_at(split_population(b.event_transactions(spark, folder), 0.025), 0.025)
    rule_stream.write_rule_stream(rules, path)
    return show_exchanged(rule_stream.read_rule_stream(spark, path))


@query("rule_store_roundtrip", sql.query(FLAT, sql.histogram(), sql.KL, select=EXCHANGED))
def rule_store_roundtrip(spark, folder):
    path = new_path(spark, "rule-store")
    split = split_population(b.flat_transactions(spark, folder), 0.05)
    for support in (0.05, 0.1):
        tables.write_rule_set(rules_at(split, support), path, "flat", "kl", support)
    return show_exchanged(tables.read_rule_set(spark, path, "flat", "kl", 0.05))


@query(
    "rule_text_file",
    sql.query(
        BASKETS, sql.histogram(), sql.MEAN, sql.top(),
        select="""SELECT array_to_string(s, ' ∧ ') || ' ⇒ ' || CAST(CAST(ceil(mean) AS BIGINT) AS VARCHAR) AS rule FROM ranked""",
    ),
)
def rule_text_file(spark, folder):
    path = new_path(spark, "rule-text")
    exchange.write_rule_text(discover_rules(b.baskets(spark, folder), 0.05, "mean"), path)
    return spark.read.text(path).select(F.col("value").alias("rule"))


@query(
    "csv_roundtrip",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys
FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""",
)
def csv_roundtrip(spark, folder):
    path = new_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    tables.write_csv(b.table(spark, folder, "orders").select(*columns), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string"
    orders = tables.read_csv(spark, path, schema).filter(F.col("o_orderstatus") != "P")
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("keys")
    )


@query(
    "indexed_lines",
    f"""WITH {FLAT}, c AS (SELECT target, CAST(sum(weight) AS BIGINT) AS n FROM tx GROUP BY target)
SELECT 'all' AS itemset, 0.25 AS score, target, n FROM c""",
)
def indexed_lines(spark, folder):
    """A histogram written with an index column, read without it, and a rule that a file
    holds twice: the later line counts."""
    path, lines = new_path(spark, "indexed"), new_path(spark, "twice")
    counts = b.flat_transactions(spark, folder).groupBy("target").agg(F.sum("weight").alias("n"))
    tables.write_csv(counts.select(F.col("target").alias("_c0"), "target", "n"), path)
    cells = tables.read_csv(spark, path, "_c0 bigint, target bigint, n bigint").withColumn("itemset", F.array(F.lit("all")))
    head = spark.range(1).select(F.array(F.lit("all")).alias("itemset"), F.lit(0.5).alias("score"), F.lit(0).cast("bigint").alias("position"))
    old = exchange.rule_lines(RuleSet(head, cells.filter("n % 2 = 0")))
    new = exchange.rule_lines(RuleSet(head.withColumn("score", F.lit(0.25)), cells))
    both = old.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1)))
    both.coalesce(1).sortWithinPartitions("at").select("value").write.text(lines)
    return show_exchanged(exchange.read_rule_lines(spark, lines))


@query("csv_inferred", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def csv_inferred(spark, folder):
    paths = {}
    for name in ("nation", "region"):
        paths[name] = new_path(spark, name)
        tables.write_csv(b.table(spark, folder, name), paths[name])
    nation, region = (tables.read_csv(spark, paths[name]) for name in ("nation", "region"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(
    "value_file_roundtrip",
    "SELECT CAST(l_quantity AS BIGINT) AS target, count(*) AS n FROM lineitem GROUP BY 1",
)
def value_file_roundtrip(spark, folder):
    path = new_path(spark, "values")
    lines = b.table(spark, folder, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("target"))
    tables.write_values(lines.agg(F.count(F.lit(1)).alias("n")), path)
    return tables.read_values(spark, path)
