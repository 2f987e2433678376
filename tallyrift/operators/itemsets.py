"""Frequent itemsets over weighted transactions.

Items are replaced by their rank in ascending frequency, so the first id of a
sorted itemset is its rarest item. Itemsets are counted by vertical bitmaps inside
blocks of transactions (``operators/vertical.py``); blocks send sums, which combine on
the map side. Up to LOCAL_SETS wanted itemsets travel with the plan as one prefix tree.
More of them stay a table: ranges of itemsets become prefix trees of their own, and each
block goes once to every tree whose first items it holds, cut to the items that matter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.operators import vertical
from tallyrift.operators.ranking import number_rows
from tallyrift.session import local_table, materialize

LOCAL_SETS = 10_000
LITERAL_ITEMS = 200
TREE_SETS = 20_000  # itemsets of one of many prefix trees
TREE_ROWS = 1 << 13  # transactions that meet such a tree at a time
COPIES = 16  # how often FP-growth sees a merged transaction on average
GROWTH_ROWS = 1_000_000  # transactions of one task of FP-growth
IDS = {"ids": pa.list_(pa.int32())}


@dataclass(frozen=True)
class Encoded:
    """Transactions over frequent items, ready for repeated passes."""

    rows: DataFrame  # ids array<int>, target, weight
    totals: DataFrame  # target, n_tot
    items: DataFrame  # id, item, freq; ids from 0, rarest first
    width: int  # number of items
    n: int
    min_support: float

    @property
    def min_count(self) -> int:
        return math.ceil(self.min_support * self.n)


def _item_lookup(items: list[tuple[str, int]], ids: dict[str, int]):
    """Item -> id as a literal: a few hash buckets of small maps, because a map
    lookup compares keys one by one."""
    size = max(1, len(items) // 8)
    buckets: list[list[Column]] = [[] for _ in range(size)]
    for item, hashed in items:
        buckets[hashed % size] += [F.lit(item), F.lit(ids[item])]
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    table = F.array(*[F.create_map(*pairs) if pairs else empty for pairs in buckets])

    def lookup(item: Column) -> Column:
        bucket = F.pmod(F.xxhash64(item), F.lit(size).cast("bigint")).cast("int")
        return F.try_element_at(F.get(table, bucket), item)

    return lookup


def _ids_by_lookup(source: DataFrame, known: list[tuple[str, int]]) -> DataFrame:
    """Items replaced by ids with a literal dictionary of ``item, hash`` in the order of ids."""
    lookup = _item_lookup(known, {item: at for at, (item, _) in enumerate(known)})
    ids = F.array_sort(F.array_compact(F.transform(F.array_compact(F.array_distinct("items")), lookup)))
    return source.select((ids if known else F.array().cast("array<int>")).alias("ids"), "target", "weight")


def _ids_by_join(source: DataFrame, items: DataFrame) -> DataFrame:
    """Items replaced by ids by meeting the dictionary; rows are put together again by a
    number that lives inside this one plan."""
    # numbered before the explosion: in one step every item would get a number of its own
    numbered = source.withColumn("_row", F.monotonically_increasing_id())
    exploded = numbered.select("_row", "target", "weight", F.explode_outer(F.array_distinct("items")).alias("item"))
    return (
        exploded.join(items.select("id", "item"), "item", "left")
        .groupBy("_row", "target", "weight")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select("ids", "target", "weight")
    )


def encode(transactions: DataFrame, min_support: float) -> Encoded:
    """Drop infrequent items, number the others and merge equal transactions.

    The most frequent items are looked at first. If there are at most LITERAL_ITEMS
    frequent ones they become a literal of the plan; otherwise the dictionary is a table
    that items meet in a join, and nothing of it is fetched. Both give the same ids."""
    source = materialize(transactions.select("items", "target", "weight"), "transactions")
    # one null per transaction counts the transactions themselves
    distinct = F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.array_distinct("items")))
    counted = source.select(F.explode(distinct).alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("freq"))
    first = counted.orderBy(F.col("item").isNotNull(), F.desc("freq"), "item").limit(LITERAL_ITEMS + 2)
    first = first.select("item", "freq", F.xxhash64("item").alias("hashed")).collect()
    n = first[0].freq if first else 0
    least = max(math.ceil(min_support * n), 1)
    known = sorted((r.freq, r.item, r.hashed) for r in first[1:] if r.freq >= least)
    width = len(known)
    if width <= LITERAL_ITEMS:
        columns = {"id": list(range(width)), "item": [k[1] for k in known], "freq": [k[0] for k in known]}
        items = local_table(source.sparkSession, columns, {"id": pa.int32(), "item": pa.string(), "freq": pa.int64()})
        encoded = _ids_by_lookup(source, [k[1:] for k in known])
    else:
        frequent = materialize(counted.where(F.col("item").isNotNull() & (F.col("freq") >= least)), "frequent")
        width = frequent.count()
        numbered = number_rows(frequent, [F.col("freq"), F.col("item")], "id", width)
        items = materialize(numbered.select(F.col("id").cast("int"), "item", "freq"), "items")
        encoded = _ids_by_join(source, items)
    rows = materialize(encoded.groupBy("ids", "target").agg(F.sum("weight").alias("weight")), "encoded")
    totals = materialize(rows.groupBy("target").agg(F.sum("weight").alias("n_tot")), "totals")
    return Encoded(rows, totals, items, width, n, min_support)


def _schema(by_target: bool) -> str:
    return "at bigint, target bigint, n bigint" if by_target else "at bigint, n bigint"


def _by_one_tree(rows: DataFrame, sets: list[tuple[int, list[int]]], by_target: bool) -> DataFrame:
    tree, sums_in, blocks = vertical.prefix_tree(sets), vertical.sums_in, vertical.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield sums_in(block, tree, by_target)

    return rows.select("ids", "target", "weight").mapInArrow(run, _schema(by_target))


def _by_many_trees(rows: DataFrame, sets: DataFrame, count: int, by_target: bool) -> DataFrame:
    """``sets`` has ``at, ids``. Trees hold ranges of itemsets, so that few trees share a first
    item; trees and blocks meet by the number of the tree and a salt, since there may be
    fewer trees than tasks."""
    spark = rows.sparkSession
    trees = -(-count // TREE_SETS)
    spread = max(1, -(-spark.sparkContext.defaultParallelism // trees))
    ranged = materialize(
        sets.select("at", "ids").repartitionByRange(trees, "ids").withColumn("tree", F.spark_partition_id()), "ranges"
    )
    first = F.get("ids", F.lit(0))
    bounds = [tuple(r) for r in ranged.groupBy("tree").agg(F.min(first), F.max(first)).collect()]  # one row per TREE_SETS itemsets
    held = ranged.groupBy("tree").agg(F.collect_list(F.struct("at", "ids")).alias("sets"))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    blocks, part_rows = vertical.blocks, TREE_ROWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for block in blocks(batches, part_rows):
            found, row = [], np.repeat(np.arange(block.rows), np.diff(block.starts))
            for tree, low, high in bounds:
                inside = block.items >= low
                some = np.zeros(block.rows, bool)
                some[row[inside & (block.items <= high)]] = True
                if some.any():
                    kept = inside & some[row]
                    lengths = np.bincount(row[kept], minlength=block.rows)[some]
                    starts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
                    parts = (block.items[kept].astype(np.int32), starts, block.targets[some].astype(np.int64), block.weights[some].astype(np.int64))
                    found.append((tree, (made + tree) % spread, *(p.tobytes() for p in parts)))
                    made += 1
            names = ["tree", "salt", "items", "starts", "targets", "weights"]
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            columns = list(zip(*found)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    numbers = "tree int, salt int, items binary, starts binary, targets binary, weights binary"
    met = rows.select("ids", "target", "weight").mapInArrow(cut, numbers).join(held, ["tree", "salt"])
    make, sums_in, one_block = vertical.prefix_tree, vertical.sums_in, vertical.Block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                tree, *parts = (batch.column(c)[at].as_py() for c in range(5))
                if known[0] != tree:
                    known = tree, make((s["at"], s["ids"]) for s in batch.column(5)[at].as_py())
                block = one_block(*(np.frombuffer(p, t) for p, t in zip(parts, (np.int32, *[np.int64] * 3))))
                yield sums_in(block, known[1], by_target)

    slim = met.select("tree", "items", "starts", "targets", "weights", "sets")
    return slim.mapInArrow(run, _schema(by_target))


def held_by(rows: DataFrame, sets: DataFrame, count: int, by_target: bool = False) -> DataFrame:
    """``at, n`` of all ``sets`` (``at bigint, ids``, ``count`` rows) that ``rows`` hold: the
    weight of the transactions that hold them; by ``target`` if asked for."""
    if count <= LOCAL_SETS:
        found = _by_one_tree(rows, [(r.at, list(r.ids)) for r in sets.select("at", "ids").collect()], by_target)
    else:
        found = _by_many_trees(rows, sets, count, by_target)
    return found.groupBy("at", *["target"] * by_target).agg(F.sum("n").alias("n"))


def _pairs(rows: DataFrame, width: int) -> DataFrame:
    """``ids, freq`` of all pairs that transactions hold."""
    blocks, held_pairs = vertical.blocks, vertical.held_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            keys, n = held_pairs(block, width)
            yield pa.RecordBatch.from_pydict({"at": keys, "n": n})

    counted = rows.select("ids", "target", "weight").mapInArrow(run, _schema(False)).groupBy("at").agg(F.sum("n").alias("freq"))
    pair = F.array((F.floor(F.col("at") / width)).cast("int"), (F.col("at") % width).cast("int"))
    return counted.select(pair.alias("ids"), "freq")


def _extend(level: DataFrame, size: int) -> DataFrame:
    """Candidates of ``size`` items: two frequent itemsets that agree on all but
    their last item, kept when every other sub-itemset is frequent too."""
    stem = level.select(
        F.slice("ids", 1, size - 2).alias("stem"), F.get("ids", F.lit(size - 2)).alias("last")
    )
    left, right = stem.alias("l"), stem.alias("r")
    joined = left.join(
        right, (F.col("l.stem") == F.col("r.stem")) & (F.col("l.last") < F.col("r.last"))
    ).select(F.concat("l.stem", F.array("l.last", "r.last")).alias("ids"))
    for gone in range(size - 2):
        part = F.concat(F.slice("ids", 1, gone), F.slice("ids", gone + 2, size - gone - 1))
        known = level.select(F.col("ids").alias("part"))
        joined = joined.withColumn("part", part).join(known, "part", "left_semi").drop("part")
    return joined


def _ahead(frequent: list[tuple[int, ...]], room: int, sizes: int) -> list[tuple[int, ...]] | None:
    """Candidates of the next ``sizes`` sizes, the later ones assuming that the
    earlier ones turn out frequent; stops before ``room`` is exceeded. None when
    the next size alone does not fit."""
    found: list[tuple[int, ...]] = []
    current = sorted(frequent)
    while current and sizes > 0:
        known = set(current)
        by_stem: dict[tuple[int, ...], list[int]] = {}
        for ids in current:
            by_stem.setdefault(ids[:-1], []).append(ids[-1])
        if len(found) + sum(len(ends) * (len(ends) - 1) // 2 for ends in by_stem.values()) > room:
            return found or None
        joined = [(*stem, a, b) for stem, ends in by_stem.items() for a in ends for b in ends if a < b]
        current = [c for c in joined if all(c[:i] + c[i + 1 :] in known for i in range(len(c) - 2))]
        found, sizes = found + current, sizes - 1
    return found


def _level_wise(encoded: Encoded) -> list[tuple[DataFrame, int]]:
    """Frequent itemsets ``ids, freq``, with their number, in counting passes over the merged
    transactions: as many sizes at once as give at most ``LOCAL_SETS`` candidates. While
    candidates are that few they are listed by the driver. Otherwise pairs are read off the
    transactions, and larger candidates are joined and stay a table."""
    spark, width = encoded.rows.sparkSession, encoded.width
    level = encoded.items.select(F.array("id").alias("ids"), "freq")
    local = [(item,) for item in range(width)] if width <= LOCAL_SETS else None
    found, size, enough = [(level, width)], 2, F.col("freq") >= encoded.min_count
    while width >= size:  # an itemset of this size needs that many frequent parts
        listed = None if local is None else _ahead(local, LOCAL_SETS, encoded.width)
        if listed == []:
            break
        rows = encoded.rows.filter(F.size("ids") >= size)
        if listed:
            counted = _by_one_tree(rows, list(enumerate(listed)), False).groupBy("at").agg(F.sum("n").alias("freq"))
            kept = sorted(tuple(r) for r in counted.filter(enough).collect())
            columns = {"ids": [list(listed[at]) for at, _ in kept], "freq": [n for _, n in kept]}
            level, size = local_table(spark, columns, IDS | {"freq": pa.int64()}), len(listed[-1])
            found.append((level, len(kept)))
            local = [listed[at] for at, _ in kept if len(listed[at]) == size]
            width = len(local)
        else:
            if size == 2:
                counted = _pairs(rows, encoded.width)
            else:
                wanted = materialize(_extend(level, size).withColumn("at", F.monotonically_increasing_id()), "candidates")
                counted = held_by(rows, wanted, wanted.count()).withColumnRenamed("n", "freq").join(wanted, "at")
            level = materialize(counted.filter(enough).select("ids", "freq"), "level")
            width = level.count()
            local = [tuple(r.ids) for r in level.select("ids").collect()] if width <= LOCAL_SETS else None
            found.append((level, width))
        size += 1
    return found


def repeat_rows(df: DataFrame, times: str, chunk: int = 10_000, partitions: int | None = None) -> DataFrame:
    """Each row ``times`` times. Long runs are cut into chunks that are spread
    over the cluster, or over ``partitions``, before they are written out."""
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.ceil(F.col(times) / chunk) - 1)))
    size = F.least(F.lit(chunk), F.col(times) - F.col("_chunk") * chunk).cast("int")
    dealt = [c for c in df.columns if c != times] + ["_chunk"]
    spread = chunks.withColumn("_size", size).repartition(*([partitions] if partitions else []), *dealt)
    return spread.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("_size")))).drop(
        "_chunk", "_size", "_one", times
    )


def _fp_growth(encoded: Encoded) -> list[tuple[DataFrame, int]]:
    """MLlib's FP-growth knows no weights, so merged transactions are repeated: once for every
    ``unit`` of their weight, rounded up. What has enough support then has at least the support
    in units, so nothing is lost; candidates that only rounding lifted (down to COPIES /
    (COPIES + 1) of the support) go when all are counted with the weights themselves.
    FP-growth's work so follows the different transactions, not how often they come. A unit of
    1 repeats every transaction as it came, and its counts are exact."""
    spark = encoded.rows.sparkSession
    merged = materialize(encoded.rows.groupBy("ids").agg(F.sum("weight").alias("weight")), "merged")
    different = merged.count()
    unit = max(1, encoded.n // (COPIES * max(different, 1)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(encoded.n // unit + different) // GROWTH_ROWS))
    copies = F.ceil(F.col("weight") / unit).cast("bigint")
    rows = materialize(repeat_rows(merged.select("ids", copies.alias("copies")), "copies", partitions=tasks), "repeated")
    # half below the least count, since MLlib multiplies with the rows again and rounds up
    least, count = max(1, -(-encoded.min_count // unit)), rows.count()
    model = FPGrowth(itemsCol="ids", minSupport=(least - 0.5) / max(count, 1), numPartitions=tasks).fit(rows)
    found = model.freqItemsets.select(F.array_sort("items").alias("ids"), "freq")
    if unit == 1:
        found = materialize(found, "mined")
        return [(found, found.count())]
    wanted = materialize(found.select("ids").withColumn("at", F.monotonically_increasing_id()), "candidates")
    weighted = merged.withColumn("target", F.lit(0).cast("bigint"))
    counted = held_by(weighted, wanted, wanted.count()).withColumnRenamed("n", "freq").join(wanted, "at")
    found = materialize(counted.filter(F.col("freq") >= encoded.min_count).select("ids", "freq"), "mined")
    return [(found, found.count())]


def mine(encoded: Encoded, miner: str = "levels") -> tuple[DataFrame, int]:
    """``set_id, itemset, ids, freq`` of all itemsets with enough support, and
    how many there are. ``set_id`` is 0..M-1 in the order of ``ids``. ``miner``
    picks the level-wise joins or MLlib's ``fpgrowth``; both find the same."""
    parts = {"levels": _level_wise, "fpgrowth": _fp_growth}[miner](encoded)
    count = sum(size for _, size in parts)
    if count <= LOCAL_SETS:
        rows = sorted((list(row.ids), row.freq) for part, _ in parts for row in part.collect())
        # every item is an itemset, so there are at most LOCAL_SETS names
        names = {row.id: row.item for row in encoded.items.collect()}
        columns = {
            "set_id": list(range(count)),
            "itemset": [sorted(names[i] for i in ids) for ids, _ in rows],
            "ids": [ids for ids, _ in rows],
            "freq": [freq for _, freq in rows],
        }
        types = {"set_id": pa.int64(), "itemset": pa.list_(pa.string()), **IDS, "freq": pa.int64()}
        return local_table(encoded.rows.sparkSession, columns, types), count
    found = reduce(DataFrame.unionByName, [part for part, _ in parts])
    numbered = number_rows(materialize(found, "found"), [F.col("ids")], "set_id", count)
    named = (
        numbered.select("set_id", "ids", "freq", F.explode("ids").alias("id"))
        .join(encoded.items.select("id", "item"), "id")
        .groupBy("set_id", "ids", "freq")
        .agg(F.array_sort(F.collect_list("item")).alias("itemset"))
    )
    return materialize(named.select("set_id", "itemset", "ids", "freq"), "itemsets"), count


def frequent_itemsets(transactions: DataFrame, min_support: float, miner: str = "levels") -> DataFrame:
    """``itemset, freq`` of all itemsets held by at least ``min_support``."""
    return mine(encode(transactions, min_support), miner)[0].select("itemset", "freq")
