"""The given tables in the roles the pipelines expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.operators.transactions import from_columns, from_facts

FLAT_ITEMS = ["c_mktsegment", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus"]
ORDER_ITEMS = ["c_mktsegment", "o_orderstatus", "o_orderpriority"]
EVENT_ITEMS = ["event_type", "user_bucket", "weekday"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with their order and customer attributes. Orders and customers
    meet first, so the lines, the largest table, are shuffled once at most."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def flat_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return from_columns(flat_rows(spark, folder), FLAT_ITEMS, "l_quantity")


def basket_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the brand and type of their part."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def basket_transactions(facts: DataFrame) -> DataFrame:
    return from_facts(facts, "l_orderkey", {"p_brand": "brand", "p_type": "type"}, F.sum("l_quantity"))


def baskets(spark: SparkSession, folder: str) -> DataFrame:
    return basket_transactions(basket_facts(spark, folder))


def part_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as baskets of their parts themselves."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return from_facts(lines, "l_orderkey", {"l_partkey": "part"}, F.sum("l_quantity"))


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's segment; price in steps of 10,000."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderstatus", "o_orderpriority",
        F.floor(F.col("o_totalprice") / 10000).alias("price_step"),
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def order_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return from_columns(order_rows(spark, folder), ORDER_ITEMS, "price_step")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events with user bucket and weekday (1 = Sunday); value in steps of 10."""
    return table(spark, folder, "events").select(
        "event_type",
        (F.col("user_id") % 4).alias("user_bucket"),
        F.dayofweek("ts").alias("weekday"),
        F.floor(F.col("value") / 10).alias("value_step"),
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return from_columns(event_rows(spark, folder), EVENT_ITEMS, "value_step")
