"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are counted by pattern (the set of sources they belong to). A pattern can send
each of its words to any of its sources, first once, then a second and a third time at a
higher cost, so repetition spreads evenly before anything is repeated more often. The flow
that fills the quotas at least cost says how many words of every pattern to take; seeded
hashes then pick the documents."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrift.llm.common import fresh
from tallyrift.operators.ranking import number_rows
from tallyrift.session import materialize

LISTED_PATTERNS = 10_000
BUCKET_ROWS, MOST_BUCKETS = 1000, 1 << 16
EPSILON = 1e-9


def capped_targets(sizes: DataFrame, total: int, most: int = 3) -> DataFrame:
    """``sizes`` (``source, source_size, weight``) with ``target``: ``total`` shared by
    weight; nobody gets over ``most`` times its size and the excess is shared again by
    weight. The level (target per unit of weight) only rises, until nobody new is capped."""
    limit, capped, level = F.col("source_size") * most, 0, 0.0
    while total:  # nothing to share leaves the level at 0
        full = F.lit(level) * F.col("weight") > limit if level else F.lit(False)
        row = sizes.agg(
            F.sum(F.when(full, limit).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(full, 1).otherwise(0)).alias("capped"),
        ).first()
        if level and row.capped == capped or not row.weights:
            break
        capped, level = row.capped, (total - row.given) / row.weights
    shared = F.lit(level) * F.col("weight")
    return sizes.withColumn("target", F.when(shared > limit, limit.cast("double")).otherwise(shared).cast("double"))


def min_cost_flow(supply: dict, quota: dict, levels: list[float]) -> dict:
    """Words each (pattern, source) pair sends. ``supply``: words of each pattern (a tuple of
    sources); each can be sent ``len(levels)`` times, the k-th time at cost ``levels[k]``.
    Successive shortest paths with node potentials; parts that share no source apart."""
    parent = {s: s for s in quota}

    def find(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for pattern in supply:
        for s in pattern[1:]:
            parent[find(s)] = find(pattern[0])
    parts = defaultdict(list)
    for pattern in supply:
        if pattern:
            parts[find(pattern[0])].append(pattern)
    sent: dict = {}
    for patterns in parts.values():
        sent |= _flow(patterns, supply, quota, levels)
    return sent


def _flow(patterns: list, supply: dict, quota: dict, levels: list[float]) -> dict:
    sources = sorted({s for p in patterns for s in p}, key=str)
    number = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    heads: list[list[int]] = [[] for _ in range(2 + len(patterns) + len(sources))]
    to, room, cost = [], [], []

    def arc(a: int, b: int, capacity: float, price: float) -> int:
        for end, back, c, w in ((b, a, capacity, price), (a, b, 0.0, -price)):
            heads[back].append(len(to))
            to.append(end)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    routes = {}
    for i, pattern in enumerate(patterns):
        for price in levels:
            arc(0, 2 + i, float(supply[pattern]), price)
        for s in pattern:
            routes[pattern, s] = arc(2 + i, number[s], float(supply[pattern]) * len(levels), 0.0)
    for s in sources:
        arc(number[s], 1, float(quota.get(s, 0.0)), 0.0)
    least = EPSILON * max([1.0, *(float(quota.get(s, 0.0)) for s in sources)])
    height = [0.0] * len(heads)
    while True:
        far, via, queue = [float("inf")] * len(heads), [-1] * len(heads), [(0.0, 0)]
        far[0] = 0.0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in heads[a]:
                if room[e] > least and (x := d + cost[e] + height[a] - height[to[e]]) < far[to[e]] - 1e-12:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(queue, (x, to[e]))
        if via[1] < 0:
            return {pair: room[e ^ 1] for pair, e in routes.items()}
        height = [h + f if f < float("inf") else h for h, f in zip(height, far)]
        path, node = [], 1
        while node:
            path.append(via[node])
            node = to[via[node] ^ 1]
        pushed = min(room[e] for e in path)
        for e in path:
            room[e] -= pushed
            room[e ^ 1] += pushed


def _routed(patterns: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """``pattern, words, docs, routed``: the words to take from each pattern.

    A pattern whose only source appears in no other pattern is a flow of its own with one
    answer, its quota up to ``most`` times its words. Beyond LISTED_PATTERNS patterns those
    are answered where they are; linked patterns are always solved together, by the driver,
    which holds a few numbers for each."""
    each = F.explode("pattern").alias("source")
    spark = patterns.sparkSession
    listed, rest = patterns, None
    if patterns.count() > LISTED_PATTERNS:
        shared = patterns.select("pattern", each).groupBy("source").count().where("count > 1").select(F.col("source").alias("_s"))
        links = patterns.select("pattern", each).join(shared, F.col("source").eqNullSafe(F.col("_s")), "left_semi")
        linked = links.select("pattern").distinct().union(patterns.where(F.size("pattern") > 1).select("pattern")).distinct()
        listed = patterns.join(linked, "pattern", "left_semi")
        alone = patterns.join(linked, "pattern", "left_anti").withColumn("_source", F.get("pattern", F.lit(0)))
        rest = alone.join(quotas, F.col("_source").eqNullSafe(F.col("source"))).select(
            "pattern", "words", "docs", F.least(F.col("quota"), F.col("words") * float(most)).alias("routed")
        )
    needed = listed.select(each).distinct().withColumnRenamed("source", "_s")
    quota = {r.source: r.quota for r in quotas.join(needed, F.col("source").eqNullSafe(F.col("_s")), "left_semi").collect()}
    rows = listed.collect()
    sent = min_cost_flow({tuple(r.pattern): r.words for r in rows}, quota, [float(k * k) for k in range(most)])
    total: dict = defaultdict(float)
    for (pattern, _), words in sent.items():
        total[pattern] += words
    solved = spark.createDataFrame(
        [(list(r.pattern), r.words, r.docs, total[tuple(r.pattern)]) for r in rows], "pattern array<string>, words long, docs long, routed double"
    )
    return solved if rest is None else solved.unionByName(rest)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """First fit: in the order of the seeded hash, every document that still fits."""
    rows = rows.sort_values(["_hash", "_size"], kind="stable").reset_index(drop=True)
    left, more = float(rows["_left"].iloc[0]) + 0.5 if len(rows) else 0.0, []
    for size in rows["_size"]:
        more.append(1 if size <= left else 0)
        left -= size * more[-1]
    rows["_more"] = more
    return rows


def mix(docs: DataFrame, members: Column, size: Column, quotas: DataFrame, id_col: str = "doc_id", most: int = 3, seed: int = 7, name: str = "repeats") -> DataFrame:
    """``docs`` plus ``name`` (0 to ``most``): how often the mix takes each row.

    ``members`` is the array of sources a row belongs to, ``size`` its words, ``quotas`` has
    ``source, quota`` (a null source is a source of its own). All rows of a pattern are
    taken ``floor(routed / words)`` times; the rest goes to rows in the order of a seeded
    hash of id and size: whole hash buckets, then first fit inside the bucket where the
    quota ends. Rows without any source, or of a pattern without words, are taken 0 times.
    A null size counts 0. Repeated rows are rows of their own. No rows give no rows."""
    named = {c: fresh("column") for c in docs.columns}  # no name of the input can clash
    pattern, words, hashed = "_pattern", "_size", "_hash"
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in named.items()),
        F.transform(F.array_sort(F.transform(F.array_distinct(members), lambda s: F.struct(s.isNull().alias("n"), s.alias("s")))), lambda x: x["s"]).alias(pattern),
        F.coalesce(size, F.lit(0)).cast("bigint").alias(words),
    ).withColumn(hashed, F.xxhash64(F.lit(seed), F.col(named[id_col]), F.col(words)))
    patterns = materialize(
        rows.where(F.size(pattern) > 0).groupBy(F.col(pattern).alias("pattern")).agg(F.sum(words).alias("words"), F.count(F.lit(1)).alias("docs")),
        "patterns",
    )
    routed = _routed(patterns, quotas, most).where("words > 0")
    routed = routed.select(
        F.col("pattern").alias("_p"),
        F.floor(F.col("routed") / F.col("words") + EPSILON).cast("int").alias("_base"),
        F.greatest(F.lit(1), F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("docs") / BUCKET_ROWS))).cast("bigint").alias("_buckets"),
        "routed", "words",
    ).withColumn("_rest", F.col("routed") - F.col("_base") * F.col("words"))
    routed = materialize(routed.drop("routed", "words"), "routed")
    dealt = rows.join(routed, F.col(pattern) == F.col("_p"), "left").drop("_p")
    dealt = dealt.withColumn("_bucket", F.pmod(hashed, "_buckets"))
    sums = dealt.where(F.col("_rest") > 0).groupBy(pattern, "_bucket").agg(F.sum(words).alias("_sum"), F.first("_rest").alias("_quota"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(pattern).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_left", F.col("_quota") - before).where("_left > 0")
    states = materialize(sums.select(F.col(pattern).alias("_p"), F.col("_bucket").alias("_b"), "_left", (F.col("_sum") <= F.col("_left")).alias("_whole")), "buckets")
    dealt = dealt.join(states, (F.col(pattern) == F.col("_p")) & (F.col("_bucket") == F.col("_b")), "left")
    extra = F.when(F.col("_whole"), 1).otherwise(0)
    repeats = F.least(F.lit(most), F.coalesce("_base", F.lit(0)) + F.col("_more")).cast("int").alias(name)
    returned = [*(F.col(n).alias(c) for c, n in named.items()), repeats]
    settled = dealt.where(F.col("_whole").isNull() | F.col("_whole")).withColumn("_more", extra)
    last = dealt.where(~F.col("_whole")).select(*named.values(), "_base", words, hashed, "_left", pattern)
    schema = f"{last.schema.toDDL()}, `_more` int"
    filled = last.groupBy(pattern).applyInPandas(_fill, schema)
    return settled.select(returned).union(filled.select(returned))


def weighted_sources(docs: DataFrame, size: str, source: str = "source", most: int = 3) -> DataFrame:
    """``source, source_size, weight, target``: sources by code point, null last, weigh
    1, 2, 3 and so on in turn and share 100% of all sizes, capped (``capped_targets``)."""
    sizes = materialize(docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size")), "sizes")
    order = [F.col("source").isNull(), F.col("source")]
    numbered = materialize(number_rows(sizes, order, "_place"), "sources")
    weighed = numbered.withColumn("weight", (F.col("_place") % 3 + 1).cast("bigint")).drop("_place")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    return materialize(capped_targets(weighed, total, most), "targets")
