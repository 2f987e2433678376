"""Rules as text: ``item,item;score;value,value``.

Items are written with ``%`` escapes for the signs that divide a line.
A value may carry a count, ``12*340``, so that a line grows with the distinct
values of a rule and not with its support. Plain values, and lines with a comma
after a score in scientific notation, are read as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.functions.text import rule_text
from tallyrift.operators.matching import RuleSet
from tallyrift.operators.ranking import number_rows
from tallyrift.session import materialize

LINE = r"^([^;]*);([^;,]+)[;,](.*)$"
ESCAPES = {"%": "%25", ",": "%2C", ";": "%3B", "\n": "%0A", "\r": "%0D"}
MOST_COPIES = 10_000_000  # of one value in a line without counts


def escaped(item: Column) -> Column:
    for sign, code in ESCAPES.items():
        item = F.replace(item, F.lit(sign), F.lit(code))
    return item


def unescaped(item: Column) -> Column:
    for sign, code in reversed(ESCAPES.items()):
        item = F.replace(item, F.lit(code), F.lit(sign))
    return item


def rule_lines(rules: RuleSet, counted: bool = True) -> DataFrame:
    """One line per rule in column ``value``. ``counted=False`` writes every value
    out for readers that know no counts; a line then holds the whole support, and a
    value with more than MOST_COPIES copies ends the job."""
    entry = F.concat(F.col("target").cast("string"), F.lit("*"), F.col("n").cast("string"))
    if not counted:
        most = F.raise_error(F.lit("too many copies for a line without counts")).cast("int")
        copies = F.when(F.col("n") <= MOST_COPIES, F.col("n").cast("int")).otherwise(most)
        entry = F.substring(F.repeat(F.concat(F.lit(","), F.col("target").cast("string")), copies), 2, 2**31 - 1)
    lists = (
        rules.values.select("itemset", F.struct("target", entry.alias("entry")).alias("cell"))
        .groupBy("itemset")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["entry"]), ",").alias("list"))
    )
    joined = rules.rules.join(lists, "itemset")
    return joined.select(
        F.concat_ws(";", F.array_join(F.transform("itemset", escaped), ","), F.col("score").cast("string"), "list").alias("value")
    )


def write_rule_lines(rules: RuleSet, path: str, counted: bool = True, mode: str = "error") -> None:
    rule_lines(rules, counted).write.mode(mode).text(path)


def read_rule_lines(spark: SparkSession, path: str) -> RuleSet:
    """Parse rule lines. Items are sorted, so the order in which a miner listed
    them does not matter; of several lines for one rule the last one counts. A line
    that is no rule ends the job and is named; empty lines are skipped."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    bad = F.raise_error(F.concat(F.lit("no rule line: "), F.col("value")))
    checked = F.when(F.col("value").rlike(LINE), F.col("value")).otherwise(bad)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("value", checked).select(
        place.alias("place"),
        F.array_sort(F.transform(F.split(F.regexp_extract("value", LINE, 1), ","), unescaped)).alias("itemset"),
        F.struct(
            F.regexp_extract("value", LINE, 2).cast("double").alias("score"),
            F.split(F.regexp_extract("value", LINE, 3), ",").alias("entries"),
        ).alias("content"),
    )
    last = materialize(
        parsed.groupBy("itemset")
        .agg(F.max("place").alias("place"), F.max_by("content", "place").alias("content"))
        .select("itemset", "place", "content.score", "content.entries"),
        "parsed",
    )
    rules = number_rows(last.select("itemset", "place", "score"), [F.col("place")], "position")
    count = F.when(F.contains("entry", F.lit("*")), F.substring_index("entry", "*", -1)).otherwise(F.lit("1"))
    values = (
        last.select("itemset", F.explode("entries").alias("entry"))
        .select(
            "itemset",
            F.substring_index("entry", "*", 1).cast("bigint").alias("target"),
            count.cast("bigint").alias("n"),
        )
        .groupBy("itemset", "target")
        .agg(F.sum("n").alias("n"))
    )
    return RuleSet(rules.select("itemset", "score", "position"), values)


def write_rule_text(rules: DataFrame, path: str, style: str = "plain", mode: str = "error") -> None:
    """The few best rules as readable lines in one file, best first."""
    lines = rules.orderBy("rank").select(rule_text(style=style).alias("value"))
    lines.coalesce(1).write.mode(mode).text(path)
