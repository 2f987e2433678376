"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no input can have by chance."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of about ``limit`` bytes; a larger row stands alone."""
    start = total = 0
    for at, size in enumerate(sizes):
        if at > start and total + size > limit:
            yield start, at
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """``start, stop, texts`` of runs of rows, so that no more than about ``limit`` bytes of a
    batch are Python objects at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for start, stop in slices(sizes, limit):
        yield start, stop, texts(column.slice(start, stop - start))


def gives_back(function):
    """For a function over batches: when its task ends, freed memory goes back to the system.
    The worker process stays beside the executor and would keep it otherwise."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole groups; the input is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            if count >= rows:  # close the open group at its last row in this batch
                last = held[-1].column(key)[held[-1].num_rows - 1].as_py()
                keys = batch.column(key).to_numpy(zero_copy_only=False)
                end = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                if end:
                    held.append(batch.slice(0, end))
                if end < len(keys):
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
                batch = batch.slice(end)
            else:
                held.append(batch.slice(0, rows))
                count += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
    if held:
        yield pa.Table.from_batches(held)


def split_hot(rows: DataFrame, key: str, limit: int, spread: Column, label: str) -> DataFrame:
    """Cut groups of over ``limit`` rows so that all pairs of rows still meet.

    A hot group is dealt into parts by ``spread``; every two parts (and a part
    with itself) form a group of their own, so the largest task sees about twice
    ``limit`` rows and no pair is lost. ``rows`` is a stored table; ``key`` is a
    bigint and is replaced by the key of the smaller group."""
    hot = materialize(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit), label
    )
    if hot.isEmpty():
        return rows
    hot = hot.select(F.col(key), F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.pmod(spread, F.col("_parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    pair = F.xxhash64(key, F.least("_part", "_other"), F.greatest("_part", "_other"))
    return (
        dealt.withColumn("_other", other)
        .withColumn(key, F.when(F.col("_parts").isNull(), F.col(key)).otherwise(pair))
        .select(*rows.columns)
    )


def share(rows: int, each: int, most: int = 1 << 16) -> int:
    """How many parts of ``each`` rows, at least one and at most ``most``."""
    return max(1, min(most, math.ceil(rows / each)))
