"""String and array expressions for codes, items and rule text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# How code systems are told apart and how long a code's stem is.
CODE_PATTERNS = {"icd9": r"^\d", "icd10": r"^[A-Za-z]"}
CODE_STEM = 3
DIAGNOSIS_SUFFIX = "_diagnose"
PROCEDURE_SUFFIX = "_procedure"


def split_list(column: str) -> Column:
    """A comma-separated list as trimmed strings."""
    return F.transform(F.split(F.col(column), ","), lambda part: F.trim(part))


def without_dots(code: Column) -> Column:
    return F.replace(code, F.lit("."), F.lit(""))


def lookup(column: str, table: Mapping[str, object]) -> Column:
    """Value of a small fixed table; null for anything not in it."""
    pairs = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(column))


def shorten_item(item: Column, depth: int) -> Column:
    """A diagnosis code cut to its stem plus ``depth`` characters; other items
    and codes no longer than the stem stay as they are."""
    code = F.substring_index(item, "_", 1)
    rest = F.substring(item, F.length(code) + 1, F.length(item))
    shorter = F.concat(F.substring(code, 1, CODE_STEM + max(depth, 0)), rest)
    longer = F.contains(item, F.lit(DIAGNOSIS_SUFFIX)) & (F.length(code) > CODE_STEM)
    return F.when(longer, shorter).otherwise(item)


def shorten_itemset(itemset: str, depth: int) -> Column:
    return F.array_sort(F.transform(itemset, lambda item: shorten_item(item, depth)))


def plain_item(item: Column) -> Column:
    """``namespace=value`` as it reads in a rule: codes keep their kind as a
    suffix, everything else is just the value."""
    kind = F.substring_index(item, "=", 1)
    value = F.substring(item, F.length(kind) + 2, F.length(item))
    return (
        F.when(kind == "diagnose", F.concat(value, F.lit(DIAGNOSIS_SUFFIX)))
        .when(kind == "procedure", F.concat(value, F.lit(PROCEDURE_SUFFIX)))
        .when(F.contains(item, F.lit("=")), value)
        .otherwise(item)
    )


def rule_text(itemset: str = "itemset", mean: str = "mean", style: str = "plain") -> Column:
    """``a ∧ b ⇒ 12``: the items and the mean rounded up. ``latex`` writes the
    operators as commands and drops blanks inside items."""
    if style == "latex":
        items = F.transform(itemset, lambda item: F.replace(item, F.lit(" "), F.lit("")))
        conjunction, arrow = r" $\wedge$ ", r" $\Rightarrow$ "
    else:
        items, conjunction, arrow = F.col(itemset), " ∧ ", " ⇒ "
    return F.concat(F.array_join(items, conjunction), F.lit(arrow), F.ceil(mean).cast("string"))
