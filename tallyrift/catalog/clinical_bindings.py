"""The given tables in the shape of the two clinical databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.catalog.bindings import table
from tallyrift.plans.clinical import ADMISSION_TYPE_OF_SOURCE

# The known sources, and one that is unknown.
SOURCES = [*ADMISSION_TYPE_OF_SOURCE, "Somewhere else"]


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderpriority").alias("admission_type"),
        F.concat(F.lit("Plan "), F.pmod("o_custkey", F.lit(3)).cast("string")).alias("insurance"),
        (F.col("o_orderstatus") == "P").cast("int").alias("hospital_expire_flag"),
    )


def _line_parts(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return _line_parts(spark, folder).select(
        F.col("l_orderkey").alias("hadm_id"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("40")).alias("icd_code"),
        F.lit(9).alias("icd_version"),
    )


def procedures(spark: SparkSession, folder: str) -> DataFrame:
    """Only returned or accepted lines count, so some admissions have none."""
    return (
        _line_parts(spark, folder)
        .filter(F.col("l_returnflag") != "N")
        .select(F.col("l_orderkey").alias("hadm_id"), F.col("p_type").alias("icd_code"), F.lit(9).alias("icd_version"))
    )


def stays(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("subject_id"),
        F.col("l_orderkey").alias("hadm_id"),
        (F.col("l_quantity") / 4).alias("los"),
        F.col("l_shipdate").alias("intime"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    gender = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("F")).when(
        F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE"), F.lit("M")
    )
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.coalesce(gender, F.lit("?")).alias("gender")
    )


def first_database(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    parts = (admissions, diagnoses, procedures, stays, patients)
    return tuple(part(spark, folder) for part in parts)


def unit_patient(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    segment = F.col("c_mktsegment")
    sources = F.array(*[F.lit(source) for source in SOURCES])
    years = F.floor(F.col("c_acctbal") / 100).cast("int")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("patientunitstayid"),
        F.when(segment == "BUILDING", F.lit("Female")).when(segment == "MACHINERY", F.lit("Male"))
        .when(segment == "HOUSEHOLD", F.lit("Female")).when(segment == "FURNITURE", F.lit("Other"))
        .otherwise(F.lit("Male")).alias("gender"),
        F.get(sources, F.pmod("o_custkey", F.lit(16)).cast("int")).alias("hospitaladmitsource"),
        F.lit(-600).alias("hospitaladmitoffset"),
        (F.floor(F.col("o_totalprice") / 40) - 1000).cast("int").alias("unitdischargeoffset"),
        F.when(F.col("o_orderstatus") == "P", F.lit("Expired"))
        .when(F.col("o_orderpriority") != "5-LOW", F.lit("Alive")).alias("hospitaldischargestatus"),
        F.when(years > 89, F.lit("> 89")).otherwise(years.cast("string")).alias("age"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("uniquepid"),
    )


def unit_diagnosis(spark: SparkSession, folder: str) -> DataFrame:
    """Lists that mix two code systems, with dots and blanks; some are missing."""
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit(""))
    old = F.concat(F.lpad(F.pmod("p_size", F.lit(7)).cast("string"), 3, "40"), F.lit("."), brand)
    new = F.concat(F.lit("I"), F.lpad(brand, 2, "0"), F.lit("."), F.substring("p_type", 1, 1))
    both = F.concat(old, F.lit(", "), new)
    listed = F.when(F.col("l_returnflag") == "R", both).when(F.col("l_returnflag") == "A", F.concat(new, F.lit(" ")))
    return _line_parts(spark, folder).select(
        F.col("l_orderkey").alias("patientunitstayid"), listed.alias("icd9code")
    )
