"""Dictionaries id <-> code and the integer item namespace."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.operators.itemsets import LITERAL_ITEMS, _item_lookup
from tallyrift.operators.ranking import number_rows
from tallyrift.session import materialize

# First id of every item namespace; gender itself is 0 or 1. A namespace
# that outgrows its range moves the later ones, see ``namespace_starts``.
OFFSETS = {"insurance": 10, "admission_type": 100, "procedure": 1000, "diagnose": 20000}
GENDER_TEXT = {0: "female", 1: "male"}
SUFFIXES = {"procedure": "_procedure", "diagnose": "_diagnose"}


def namespace_starts(dictionaries: Mapping[str, DataFrame]) -> dict[str, int]:
    """Start of every namespace: its fixed one, or behind the largest id of the
    namespaces before it. Every dictionary is (id, code) with ids from 1."""
    starts, end = {}, 0
    for kind, fixed in OFFSETS.items():
        starts[kind] = max(fixed, end)
        if kind in dictionaries:
            table = dictionaries[kind]
            end = starts[kind] + (table.agg(F.max(table.columns[0])).first()[0] or 0)
    return starts


def build_dictionary(rows: DataFrame, code: str, identifier: str) -> DataFrame:
    """Distinct codes numbered from 1 in code order."""
    codes = materialize(rows.select(code).filter(F.col(code).isNotNull()).distinct(), "codes")
    return number_rows(codes, [F.col(code)], identifier).withColumn(
        identifier, (F.col(identifier) + 1).cast("int")
    )


def encode_column(rows: DataFrame, dictionary: DataFrame, code: str) -> DataFrame:
    """Replace ``code`` by its id. The dictionary grows with the data, so whether
    it is broadcast is left to its measured size."""
    return rows.join(dictionary, code, "inner").drop(code)


def code_lookup(dictionary: DataFrame) -> Callable[[Column], Column] | None:
    """Code -> id as a literal of the plan, null for unknown codes; None where ``dictionary``
    (id, code) has too many codes for that, or codes that are no text."""
    identifier, code = dictionary.columns
    if dict(dictionary.dtypes)[code] != "string":
        return None
    rows = dictionary.select(identifier, code, F.xxhash64(code)).limit(LITERAL_ITEMS + 1).collect()
    if len(rows) > LITERAL_ITEMS:
        return None
    if not rows:
        return lambda value: F.lit(None).cast("int")
    return _item_lookup([(name, hashed) for _, name, hashed in rows], {name: number for number, name, _ in rows})


def encode_sets(rows: DataFrame, dictionary: DataFrame, sets: str, key: Sequence[str], name: str) -> DataFrame:
    """Add the ids of the codes in the array ``sets`` as ``name``; rows without a known code, and
    those with a null in ``key``, drop out. A small dictionary is looked up inside the row. With
    a large one codes and dictionary meet, and rows are put together again by ``key``, on which
    ``sets`` must depend alone."""
    lookup, (identifier, code) = code_lookup(dictionary), dictionary.columns
    if lookup is not None:
        # the filter stops at the first known code; one on the ids would find all of them twice
        some = rows.dropna(subset=list(key)).filter(F.exists(sets, lambda code: lookup(code).isNotNull()))
        return some.withColumn(name, F.array_compact(F.transform(F.array_distinct(sets), lookup)))
    long = rows.select(*key, F.explode(sets).alias(code))
    found = encode_column(long, dictionary, code).groupBy(*key).agg(F.collect_set(identifier).alias(name))
    return rows.join(found, list(key))


def item_dictionary(dictionaries: Mapping[str, DataFrame], starts: Mapping[str, int] | None = None) -> DataFrame:
    """``item, item_text`` of all namespaces; every dictionary is (id, code).
    ``starts`` defaults to the starts that these dictionaries need."""
    starts = namespace_starts(dictionaries) if starts is None else starts
    gender = " UNION ALL ".join(f"SELECT {i} AS item, '{t}' AS item_text" for i, t in GENDER_TEXT.items())
    table = next(iter(dictionaries.values())).sparkSession.sql(gender)
    for kind, dictionary in dictionaries.items():
        identifier, code = dictionary.columns
        named = F.concat(F.col(code).cast("string"), F.lit(SUFFIXES.get(kind, "")))
        table = table.unionByName(
            dictionary.select((F.col(identifier) + starts[kind]).cast("int").alias("item"), named.alias("item_text"))
        )
    return table


def decode_items(rules: DataFrame, dictionary: DataFrame, key: str, items: str) -> DataFrame:
    """Item ids of each rule as text, in text order. An id nobody knows stays as it is."""
    exploded = rules.select(key, F.explode(items).alias("_id")).withColumn("item", F.col("_id").try_cast("int"))
    texts = exploded.join(dictionary, "item", "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.coalesce("item_text", F.col("_id").cast("string")))).alias("itemset")
    )
    return rules.join(texts, key, "left").withColumn(
        "itemset", F.coalesce("itemset", F.array().cast("array<string>"))
    )
