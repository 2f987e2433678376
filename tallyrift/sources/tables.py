"""CSV and Parquet tables, value files, and the partitioned rule store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyrift import schemas
from tallyrift.operators.itemsets import repeat_rows
from tallyrift.operators.matching import RuleSet

INDEX_COLUMNS = ("_c0", "")  # row numbers some writers put into the first column


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A CSV file with header. A declared schema overrides the header's names;
    without one, types are inferred at the price of another pass."""
    reader = spark.read.option("header", True)
    table = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return table.drop(*INDEX_COLUMNS)


def write_csv(table: DataFrame, path: str, mode: str = "error") -> None:
    table.write.mode(mode).option("header", True).csv(path)


def write_values(histogram: DataFrame, path: str, mode: str = "error") -> None:
    """``target, n`` as one value per line without header."""
    repeat_rows(histogram.select("target", "n"), "n").write.mode(mode).csv(path)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """A headerless file of one value per line, as ``target, n``."""
    return spark.read.schema(schemas.VALUES).csv(path).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def write_rule_set(rules: RuleSet, path: str, dataset: str, measure: str, min_support: float) -> None:
    """Write a rule set to the store, one partition per run of the sweep. A second
    write of the same run replaces the first; other runs stay."""
    for name, table in (("rules", rules.rules), ("values", rules.values)):
        (
            table.withColumn("dataset", F.lit(dataset))
            .withColumn("measure", F.lit(measure))
            .withColumn("min_support", F.lit(str(min_support)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dataset", "measure", "min_support")
            .parquet(f"{path}/{name}")
        )


def read_rule_set(spark: SparkSession, path: str, dataset: str, measure: str, min_support: float) -> RuleSet:
    """One run from the store; only its partition is read."""

    def run(name: str, columns: str) -> DataFrame:
        schema = f"{columns}, dataset string, measure string, min_support string"
        return (
            spark.read.schema(schema)
            .parquet(f"{path}/{name}")
            .filter(
                (F.col("dataset") == dataset)
                & (F.col("measure") == measure)
                & (F.col("min_support") == str(min_support))
            )
            .drop("dataset", "measure", "min_support")
        )

    return RuleSet(run("rules", schemas.RULES), run("values", schemas.RULE_VALUES))
