"""Named queries against their SQL."""

import functools
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tallyrift.catalog import all_queries, all_sql

FOLDER = os.environ.get("TALLYRIFT_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
NAMES = list(all_sql())
# On the smallest tables the parts' support is one basket, so that every set is frequent, and
# samples are too small for a closed form of first order.
LARGER = {
    name: FOLDER.replace("sf0.001", "sf0.01")
    for name in ("part_itemsets", "kl_rules_parts", "bootstrap_agrees", "bootstrap_sweep_agrees")
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@functools.cache
def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["rank", "itemset", "freq", "n_counter", "mean", "score"]


def test_names():
    assert set(all_sql()) == set(all_queries()) - {"bootstrap_se", "bootstrap_sweep"}  # their closed forms have SQL
    assert set(all_queries()) <= set(entry_points.queries()) and set(all_sql()) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    folder = LARGER.get(name, FOLDER)
    got = entry_points.queries()[name](spark, folder).toPandas()
    want = database(folder).execute(entry_points.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(tuple(map(str, row)) for row in frame[columns].itertuples(index=False))

    assert rows(got) == rows(want)
