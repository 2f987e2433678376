"""SQL building blocks for the comparison queries.

They follow the definitions literally (item self-joins, full cross of itemsets and
target values, windows), not the plans of the Spark side."""

from __future__ import annotations

FLAT = """rows AS (
  SELECT 'c_mktsegment=' || c_mktsegment AS a, 'o_orderstatus=' || o_orderstatus AS b,
         'o_orderpriority=' || o_orderpriority AS c, 'l_returnflag=' || l_returnflag AS d,
         'l_linestatus=' || l_linestatus AS e, CAST(l_quantity AS BIGINT) AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
counted AS (SELECT a, b, c, d, e, target, count(*) AS weight FROM rows GROUP BY ALL),
tx AS (SELECT row_number() OVER () AS tid, [a, b, c, d, e] AS items, target, weight FROM counted)"""

BASKETS = """tx AS (
  SELECT l_orderkey AS tid,
         list_concat(list(DISTINCT 'brand=' || p_brand), list(DISTINCT 'type=' || p_type)) AS items,
         CAST(sum(l_quantity) AS BIGINT) AS target, 1 AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

ORDERS = """counted AS (
  SELECT 'c_mktsegment=' || c_mktsegment AS a, 'o_orderstatus=' || o_orderstatus AS b,
         'o_orderpriority=' || o_orderpriority AS c, CAST(floor(o_totalprice / 10000) AS BIGINT) AS target,
         count(*) AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
tx AS (SELECT row_number() OVER () AS tid, [a, b, c] AS items, target, weight FROM counted)"""

EVENTS = """counted AS (
  SELECT 'event_type=' || event_type AS a, 'user_bucket=' || (user_id % 4) AS b,
         'weekday=' || (dayofweek(ts) + 1) AS c, CAST(floor(value / 10) AS BIGINT) AS target,
         count(*) AS weight
  FROM events GROUP BY ALL),
tx AS (SELECT row_number() OVER () AS tid, [a, b, c] AS items, target, weight FROM counted)"""


def mined(transactions: str, min_support: float, levels: int, p: str = "") -> str:
    """CTEs ``{p}itemsets(s, freq)``: k-way self-joins of the items; and
    ``{p}n(n)``. ``levels`` must exceed the longest frequent itemset."""
    parts = [
        transactions,
        f"{p}n AS (SELECT CAST(sum(weight) AS BIGINT) AS n, "
        f"CAST(ceil(CAST({min_support} AS DOUBLE) * sum(weight)) AS BIGINT) AS least FROM {p}tx)",
        f"{p}c1 AS MATERIALIZED (SELECT tid, weight, target, [item] AS s, item AS last FROM "
        f"(SELECT tid, weight, target, unnest(items) AS item FROM {p}tx) u)",
    ]
    for k in range(1, levels + 1):
        if k > 1:
            parts.append(
                f"{p}c{k} AS MATERIALIZED (SELECT i.tid, i.weight, i.target, list_append(i.s, j.last) AS s, "
                f"j.last AS last FROM {p}i{k - 1} i JOIN {p}i1 j ON i.tid = j.tid AND j.last > i.last)"
            )
        parts.append(
            f"{p}f{k} AS MATERIALIZED (SELECT s, CAST(sum(weight) AS BIGINT) AS freq FROM {p}c{k} "
            f"GROUP BY s HAVING sum(weight) >= (SELECT least FROM {p}n))"
        )
        parts.append(f"{p}i{k} AS MATERIALIZED (SELECT * FROM {p}c{k} WHERE s IN (SELECT s FROM {p}f{k}))")
    union = " UNION ALL ".join(f"SELECT s, freq FROM {p}f{k}" for k in range(1, levels + 1))
    cells = " UNION ALL ".join(f"SELECT s, target, weight FROM {p}i{k}" for k in range(1, levels + 1))
    parts.append(f"{p}itemsets AS MATERIALIZED ({union})")
    parts.append(
        f"{p}inside AS MATERIALIZED (SELECT s, target, CAST(sum(weight) AS BIGINT) AS n_set "
        f"FROM ({cells}) u GROUP BY s, target)"
    )
    return ",\n".join(parts)


def histogram(p: str = "") -> str:
    """CTE ``{p}hist(s, freq, target, n_set, n_counter)`` with all target values."""
    return f"""{p}hist AS MATERIALIZED (
  SELECT f.s, f.freq, t.target, coalesce(i.n_set, 0) AS n_set, t.n_tot - coalesce(i.n_set, 0) AS n_counter
  FROM {p}itemsets f
  CROSS JOIN (SELECT target, CAST(sum(weight) AS BIGINT) AS n_tot FROM {p}tx GROUP BY target) t
  LEFT JOIN {p}inside i ON i.s = f.s AND i.target = t.target)"""


SIDES = """sizes AS (SELECT s, freq, CAST(sum(n_counter) AS BIGINT) AS n_counter,
  sum(n_set * CAST(target AS DOUBLE)) / sum(n_set) AS mean,
  CASE WHEN sum(n_counter) > 0 THEN sum(n_counter * CAST(target AS DOUBLE)) / sum(n_counter) END AS mean_counter
  FROM hist GROUP BY s, freq)"""

KL = SIDES + """,
scored AS (SELECT z.s, z.freq, z.n_counter, z.mean,
  coalesce(sum(CASE WHEN h.n_set > 0 AND h.n_counter > 0
    THEN (h.n_counter / z.n_counter) * ln((h.n_counter / z.n_counter) / (h.n_set / z.freq)) END), 0) AS score
  FROM sizes z JOIN hist h ON h.s = z.s WHERE z.n_counter > 0 GROUP BY z.s, z.freq, z.n_counter, z.mean)"""

MEAN = SIDES + """,
spread AS (SELECT z.s, z.freq, z.n_counter, z.mean, z.mean_counter,
  sum(h.n_set * pow(h.target - z.mean, 2)) / z.freq AS var_set,
  sum(h.n_counter * pow(h.target - z.mean_counter, 2)) / z.n_counter AS var_counter
  FROM sizes z JOIN hist h ON h.s = z.s WHERE z.n_counter > 0
  GROUP BY z.s, z.freq, z.n_counter, z.mean, z.mean_counter),
scored AS (SELECT *, mean - mean_counter AS score,
  (mean - mean_counter) / sqrt(var_set / freq + var_counter / n_counter) AS z FROM spread)"""

EXPO = SIDES + """,
fits AS (SELECT z.s, z.freq, z.n_counter, z.mean, 1 / z.mean AS rate_set, 1 / z.mean_counter AS rate_counter,
  sum(CASE WHEN h.n_set > 0 THEN (h.n_set / z.freq) * (ln(h.n_set / z.freq) - ln(1 / z.mean)
    + (1 / z.mean) / 2 * (2 * h.target + 1)) END) AS fit_set,
  sum(CASE WHEN h.n_counter > 0 THEN (h.n_counter / z.n_counter) * (ln(h.n_counter / z.n_counter)
    - ln(1 / z.mean_counter) + (1 / z.mean_counter) / 2 * (2 * h.target + 1)) END) AS fit_counter
  FROM sizes z JOIN hist h ON h.s = z.s WHERE z.n_counter > 0 AND z.mean > 0 AND z.mean_counter > 0
  GROUP BY z.s, z.freq, z.n_counter, z.mean, z.mean_counter),
scored AS (SELECT *, ln(rate_counter) - ln(rate_set) + rate_set / rate_counter - 1 AS score FROM fits)"""


def _normal_side(side: str) -> str:
    return f"""{side}_walk AS (SELECT s, target, n_{side} / sum(n_{side}) OVER w AS p,
  sum(n_{side} * CAST(target AS DOUBLE)) OVER w / sum(n_{side}) OVER w AS mu, n_{side} AS n,
  sum(n_{side}) OVER w AS size, lead(target) OVER (PARTITION BY s ORDER BY target) AS edge
  FROM hist WHERE n_{side} > 0 WINDOW w AS (PARTITION BY s)),
{side}_var AS (SELECT s, sum(n * pow(target - mu, 2)) / (any_value(size) - 1) AS v FROM {side}_walk
  GROUP BY s HAVING any_value(size) > 1),
{side}_fit AS (SELECT k.s, any_value(k.mu) AS mu, any_value(v.v) AS v,
  coalesce(sum(CASE WHEN k.edge IS NOT NULL AND v.v > 0 THEN k.p * (ln(k.p) - (ln(1 / (sqrt(v.v) * sqrt(2 * pi())))
    - 0.5 * ((pow(k.edge - k.mu, 3) - pow(k.target - k.mu, 3)) / (3 * v.v)))) END), 0) AS fit
  FROM {side}_walk k JOIN {side}_var v ON v.s = k.s GROUP BY k.s)"""


NORMAL = SIDES + ",\n" + _normal_side("set") + ",\n" + _normal_side("counter") + """,
scored AS (SELECT z.s, z.freq, z.n_counter, z.mean, a.fit AS fit_set, b.fit AS fit_counter,
  a.v AS var_set, b.v AS var_counter, b.mu AS mean_counter,
  0.5 * (pow(b.mu - a.mu, 2) / pow(a.v, 2) + pow(b.v, 2) / pow(a.v, 2) + ln(pow(a.v, 2) / pow(b.v, 2)) - 1) AS score
  FROM sizes z JOIN set_fit a ON a.s = z.s JOIN counter_fit b ON b.s = z.s WHERE a.v > 0 AND b.v > 0)"""


def top(where: str = "TRUE", k: int = 10, p: str = "") -> str:
    """CTE ``{p}ranked``: the k best of ``{p}scored``."""
    return f"""{p}ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, s) AS rank FROM {p}scored
  WHERE score IS NOT NULL AND {where} QUALIFY rank <= {k})"""


def num(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def text(expression: str = "s", name: str = "itemset") -> str:
    return f"array_to_string({expression}, '|') AS {name}"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


RULE_COLUMNS = (
    f"CAST(rank AS INTEGER) AS rank, {text()}, freq, n_counter, {num('mean', 'mean')}, {num('score', 'score')}"
)
