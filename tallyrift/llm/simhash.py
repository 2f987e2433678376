"""Near-duplicates by SimHash and a hierarchical index over Gray-ordered fingerprints.

Fingerprints that differ in at most three bits agree on one of four 16-bit blocks, and,
of the 48 other bits, on one of four 12-bit blocks: 16 keys of 28 bits each. Inside a
key's group the fingerprints are sorted by Gray rank, which puts fingerprints with long
common patterns side by side. Runs of neighbours become leaves, runs of leaves become
inner nodes; a node stores the mask of the bits that all its members share. Two nodes are
compared on the bits that both masks fix; the differences found there only grow on the
way down, so a pair of nodes beyond three is dropped with everything below it.

Where a similarity is asked for, fingerprints are taken of the set of shingles. A similarity
of 0.8 leaves about 10 of 64 bits different, so keys are each of five blocks and its neighbours
at one bit, which meet if a block differs in two bits at most, within classes of set sizes.
The distance of both fingerprints together (about 19 of 128 bits at 0.8) keeps chance pairs
out, and the texts of linked fingerprints are compared by the Jaccard similarity of their
shingles. Each bit differs by chance: of pairs at exactly 0.8 about 1 in 250 is lost, fewer above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import fresh, gives_back, sorted_groups, split_hot, text_slices
from tallyrift.llm.graph import components
from tallyrift.session import materialize

DIFFERENT_BITS = 3
LEAF, FAN = 8, 8
GROUP_ROWS = 4096
FOREST_ROWS = 100_000
PAIRS_AT_ONCE = 1 << 15
KEY_BLOCKS = 5  # of two fingerprints within 14 bits one block differs in two bits at most
TWIN_BITS = 13  # what both fingerprints together may differ in beyond the first one's distance
SIZE_STEP = 4.0  # sets meet in size classes whose bounds grow by this factor
SET_ROWS = 1024


def shingles(text: bytes, width: int = 3, seed: int = 42) -> np.ndarray:
    """Hashes of all runs of ``width`` words, or of the whole text if it has fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))
    if len(words) > width:
        ends = (starts[width:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)], np.uint64)
    return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):  # sums of up to 255 bits fit a byte
        part = hashes[at : at + 255 * 256]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    return majority(shingles(text, width, seed))


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(codes: np.ndarray, groups: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Nodes of all groups, leaves first. A node covers ``start..end`` of the level below;
    the last level has one node per group."""
    all_bits = ~np.uint64(0)
    level = {"pattern": codes, "mask": np.full(len(codes), all_bits), "group": groups}
    levels, fan = [level], LEAF
    while True:
        group = level["group"]
        first = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1))
        sizes = np.diff(np.concatenate((first, [len(group)])))
        place = np.arange(len(group)) - np.repeat(first, sizes)
        start = np.flatnonzero(place % fan == 0)
        differs = np.bitwise_or.reduceat(level["pattern"] ^ np.repeat(level["pattern"][start], np.diff(np.append(start, len(group)))), start)
        mask = np.bitwise_and.reduceat(level["mask"], start) & ~differs
        level = {
            "pattern": level["pattern"][start] & mask, "mask": mask, "group": group[start],
            "start": start, "end": np.append(start[1:], len(group)),
        }
        levels.append(level)
        if sizes.max() <= fan:
            return levels
        fan = FAN


def _children(level: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs, each unordered pair once."""
    na, nb = level["end"][a] - level["start"][a], level["end"][b] - level["start"][b]
    sizes = na * nb
    pair = np.repeat(np.arange(len(a)), sizes)
    inside = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = level["start"][a][pair] + inside // nb[pair]
    right = level["start"][b][pair] + inside % nb[pair]
    once = (a[pair] != b[pair]) | (left <= right)
    return left[once], right[once]


class _Sets:
    """Disjoint sets over positions, merged a batch of links at a time."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        while len(left):
            a, b = self.root[left], self.root[right]
            differs = a != b
            left, right, a, b = left[differs], right[differs], a[differs], b[differs]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = self.root[self.root]
                if (jumped == self.root).all():
                    break
                self.root = jumped


def link_groups(codes: np.ndarray, groups: np.ndarray, bits: int = DIFFERENT_BITS, twins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links (member, smallest position) inside the groups; both
    arrays are positions in ``codes``. Nodes already joined into one set are not opened.
    With ``twins`` (second fingerprints) a link also needs that both distances together are
    at most ``bits + TWIN_BITS``."""
    order = np.lexsort((gray_rank(codes), groups))
    code = codes[order]
    twin = None if twins is None else twins[order]
    levels = _levels(code, groups[order])
    sets = _Sets(len(code))
    spans = [None]  # positions below each node: first and last
    first = last = np.arange(len(code))
    for level in levels[1:]:
        first, last = first[level["start"]], last[level["end"] - 1]
        spans.append((first, last))

    def joined(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Node pairs whose members all lie in one set."""
        low = np.minimum.reduceat(sets.root, spans[depth][0])
        high = np.maximum.reduceat(sets.root, spans[depth][0])
        return (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])

    roots = np.flatnonzero(levels[-1]["end"] - levels[-1]["start"] > (1 if len(levels) == 2 else 0))
    stack = [(len(levels) - 1, roots, roots)]
    while stack:
        depth, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack.append((depth, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        open_ = ~joined(depth, a, b)
        a, b = _children(levels[depth], a[open_], b[open_])
        below = levels[depth - 1]
        apart = np.bitwise_count((below["pattern"][a] ^ below["pattern"][b]) & below["mask"][a] & below["mask"][b])
        near = apart <= bits
        a, b = a[near], b[near]
        if depth == 1:
            if twin is not None:
                apart = apart[near] + np.bitwise_count(twin[a] ^ twin[b])
                a, b = a[apart <= bits + TWIN_BITS], b[apart <= bits + TWIN_BITS]
            sets.link(a, b)
        elif len(a):
            stack.append((depth - 1, a, b))
    linked = np.flatnonzero(sets.root != np.arange(len(code)))
    return order[linked], order[sets.root[linked]]


def block_keys(code: str) -> Column:
    """The 16 keys of a fingerprint: which two blocks, and their bits."""
    x, keys = F.col(code), []
    for b in range(4):
        outer = F.shiftrightunsigned(x, 16 * b).bitwiseAND(F.lit(0xFFFF))
        low = x.bitwiseAND(F.lit((1 << 16 * b) - 1))
        rest = low if b == 3 else F.shiftleft(F.shiftrightunsigned(x, 16 * (b + 1)), 16 * b).bitwiseOR(low)
        for s in range(4):
            inner = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit(0xFFF))
            keys.append(
                F.shiftleft(F.lit(4 * b + s).cast("bigint"), 28).bitwiseOR(F.shiftleft(outer, 12)).bitwiseOR(inner)
            )
    return F.array(*keys)


def neighbour_keys(code: str, blocks: int) -> Column:
    """Keys for larger distances: every block and its neighbours at one bit."""
    x, keys = F.col(code), []
    edges = [64 * b // blocks for b in range(blocks + 1)]
    for b, (low, high) in enumerate(zip(edges, edges[1:])):
        part = F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << high - low) - 1)) if high - low < 64 else x
        for flipped in (0, *(1 << i for i in range(high - low))):
            keys.append(F.shiftleft(F.lit(b).cast("bigint"), 50).bitwiseOR(part.bitwiseXOR(F.lit(flipped).cast("bigint"))))
    return F.array(*keys)


def sized_keys(keys: Column, size: str, similarity: float) -> Column:
    """``keys`` in the size class of the set and in that of the largest set that can be
    similar to it: two similar sets are in one of the smaller one's classes."""
    least, per = F.greatest(F.col(size), F.lit(1)), F.log(F.lit(SIZE_STEP))
    own, most = (F.floor(F.log(n) / per + 1e-9) for n in (least, least / similarity))
    return F.flatten(F.transform(F.array_distinct(F.array(own, most)), lambda c: F.transform(keys, lambda k: k.bitwiseOR(F.shiftleft(c, 57)))))


def _links(bits: int, twin: str | None):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "key", FOREST_ROWS):
            keys, codes = rows.column("key").to_numpy(), rows.column("code").to_numpy()
            start = np.concatenate(([True], keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(np.flatnonzero(start), len(keys)))
            many = np.repeat(sizes > 1, sizes)
            if many.any():
                groups, codes = np.cumsum(start)[many], codes[many]
                nodes = rows.column(twin).to_numpy()[many] if twin else codes
                member, root = link_groups(codes.view(np.uint64), groups, bits, nodes.view(np.uint64) if twin else None)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[member]), pa.array(nodes[root])], ["u", "v"])

    return run


def fingerprints(docs: DataFrame, text: str, name: str, width: int = 3) -> DataFrame:
    """``docs`` without ``text`` but with a bigint column ``name`` of its fingerprint."""
    kept = [c for c in docs.columns if c != text]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for *_, part in text_slices(batch.column(text)) for t in part]
            codes = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(codes)], [*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{name}` bigint"])
    return docs.mapInArrow(run, schema)


def near_groups(codes: DataFrame, bits: int = DIFFERENT_BITS, twin: str | None = None, similarity: float | None = None) -> DataFrame:
    """``code, root`` of every fingerprint linked to another one with a smaller value.
    ``codes`` has distinct bigints ``code``; with ``twin`` and ``similarity``, distinct rows of
    both and the ``size`` of the set, and the second fingerprint names the nodes."""
    held = ["code", twin] if twin else ["code"]
    if twin:
        keys = sized_keys(neighbour_keys("code", KEY_BLOCKS), "size", similarity)
    else:
        keys = block_keys("code") if bits <= DIFFERENT_BITS else neighbour_keys("code", bits // 3 + 1)
    keyed = materialize(codes.select(*held, F.explode(keys).alias("key")), "keys")
    keyed = split_hot(keyed, "key", GROUP_ROWS, F.xxhash64("code"), "hot")
    parts = keyed.repartition("key").sortWithinPartitions("key")
    links = parts.select("key", *held).mapInArrow(_links(bits, twin), "u bigint, v bigint")
    return components(links).select(F.col("node").alias("code"), "root")


def shingle_sets(docs: DataFrame, text: str, width: int, whole: bool = False) -> DataFrame:
    """``docs`` without ``text`` but with bigints ``code`` (a hash of the text's set of
    shingles), ``near`` and ``twin`` (its fingerprints), its ``size``, and the sorted ``set`` if ``whole``."""
    kept = [c for c in docs.columns if c != text]
    names = [*kept, "code", "near", "twin", "size", *(["set"] if whole else [])]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_slices(batch.column(text)):
                sets = [np.unique(shingles(t, width)) for t in part]
                found = [[xxhash.xxh64_intdigest(s.tobytes()) for s in sets], map(majority, sets), (majority(remixed(s)) for s in sets)]
                columns = [pa.array(np.array(list(x), np.uint64).view(np.int64)) for x in found]
                columns.append(pa.array([len(s) for s in sets], pa.int64()))
                columns += [pa.array([s.tobytes() for s in sets], pa.binary())] if whole else []
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), *columns], names)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    kinds += ["code bigint", "near bigint", "twin bigint", "size bigint", *(["set binary"] if whole else [])]
    return docs.mapInArrow(run, ", ".join(kinds))


def shingle_codes(docs: DataFrame, text: str, name: str, width: int) -> DataFrame:
    """``docs`` without ``text`` but with a bigint ``name`` that stands for its set of shingles."""
    kept = [c for c in docs.columns if c != text]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (np.unique(shingles(t, width)) for *_, part in text_slices(batch.column(text)) for t in part)
            codes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(codes)], [*kept, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text), f"`{name}` bigint"])
    return docs.mapInArrow(run, schema)


def similar_links(sets: list[np.ndarray], near: np.ndarray, twin: np.ndarray, bits: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning set of the links among sets of one candidate group: two sets are linked if
    one of their fingerprints is near and their Jaccard similarity is at least ``similarity``."""
    sizes = np.array([len(s) for s in sets])
    root, links = np.arange(len(sets)), []
    for at in range(1, len(sets)):
        close = (np.bitwise_count(near[:at] ^ near[at]) <= bits) | (np.bitwise_count(twin[:at] ^ twin[at]) <= bits)
        close &= np.minimum(sizes[:at], sizes[at]) >= similarity * np.maximum(sizes[:at], sizes[at])
        for other in np.flatnonzero(close).tolist():
            if root[other] == root[at]:
                continue
            same = len(np.intersect1d(sets[at], sets[other], assume_unique=True))
            every = sizes[at] + sizes[other] - same
            if every == 0 or same >= similarity * every:
                links.append((at, other))
                low, high = sorted((root[at], root[other]))
                root[: at + 1][root[: at + 1] == high] = low
    return links


def _similar(bits: int, similarity: float):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, "key", SET_ROWS):
            keys, codes = rows.column("key").to_numpy(), rows.column("code").to_numpy()
            near, twin = (rows.column(c).to_numpy().view(np.uint64) for c in ("near", "twin"))
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            for a, b in zip(edges, edges[1:]):
                sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").slice(a, b - a).to_pylist()]
                links = np.array(similar_links(sets, near[a:b], twin[a:b], bits, similarity), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(codes[a:b][links[:, 0]]), pa.array(codes[a:b][links[:, 1]])], ["u", "v"])

    return run


def similar_groups(rows: DataFrame, distinct: DataFrame, width: int, bits: int, similarity: float) -> DataFrame:
    """``code, root`` of every set linked to another one with a smaller code. ``rows`` has
    ``doc_id, text``; ``distinct`` has ``code, near, twin, size`` and ``first``, an id of every set.

    Groups of near fingerprints are only candidates; every link is decided by the sets
    themselves, which are made again for the candidates alone."""
    pairs = distinct.select(F.col("near").alias("code"), "twin", "size").distinct()
    roots = near_groups(pairs, bits, "twin", similarity).select(F.col("code").alias("twin"), F.col("root").alias("key"))
    placed = distinct.join(roots, "twin", "left").withColumn("key", F.coalesce("key", "twin"))
    placed = materialize(placed.select("code", "first", "key"), "placed")
    many = placed.groupBy("key").count().where("count > 1").select("key")
    asked = materialize(placed.join(many, "key", "left_semi"), "candidates")
    ids = asked.where(F.col("first").isNotNull()).select(F.col("first").alias("doc_id")).distinct()
    read = rows.join(ids, "doc_id", "left_semi").select("text")
    if not asked.where(F.col("first").isNull()).isEmpty():
        read = read.unionByName(rows.where(F.col("doc_id").isNull()).select("text"))
    sets = shingle_sets(read, "text", width, whole=True).join(asked.select("code", "key"), "code").dropDuplicates(["code"])
    sets = split_hot(materialize(sets, "sets"), "key", SET_ROWS, F.xxhash64("code"), "hot-sets")
    parts = sets.repartition("key").sortWithinPartitions("key")
    links = parts.select("key", "code", "near", "twin", "set").mapInArrow(_similar(bits, similarity), "u bigint, v bigint")
    return components(links).select(F.col("node").alias("code"), "root")


def _marked(rows: DataFrame, width: int, similarity: float | None) -> DataFrame:
    return fingerprints(rows, "text", "code", width) if similarity is None else shingle_sets(rows, "text", width)


def _grouped(docs: DataFrame, id_col: str, text: str, width: int, bits: int, similarity: float | None) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id, code``, and ``code, root, component_id`` of every fingerprint, or of
    every set of shingles if a similarity is asked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(_marked(rows, width, similarity), "fingerprints")
    marks = [F.first(c).alias(c) for c in marked.columns[2:]]
    distinct = materialize(marked.groupBy("code").agg(F.min("doc_id").alias("first"), *marks), "distinct")
    if similarity is None:
        roots = near_groups(distinct.select("code"), bits)
    else:
        roots = similar_groups(rows, distinct, width, bits, similarity)
    joined = distinct.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    joined = materialize(joined, "roots")
    named = joined.join(joined.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return marked, materialize(named.select("code", "root", "component_id"), "components")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bits: int = DIFFERENT_BITS, similarity: float | None = None
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    A null or empty text has the fingerprint zero and is linked like any other. Rows with
    equal fingerprints are always linked. A null id belongs to its component but never
    names it, unless no other id is there (then the component is null). Repeated rows stay
    repeated; other columns are ignored; no rows give no rows.

    Shingles have ``width`` words; fingerprints within ``bits`` bits are linked. With
    ``similarity`` a link also needs that Jaccard similarity of the two sets of shingles."""
    marked, named = _grouped(docs, id_col, text, width, bits, similarity)
    digits = F.lower(F.lpad(F.hex("code" if similarity is None else "near"), 16, "0"))
    return marked.join(named, "code").select("doc_id", digits.alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bits: int = DIFFERENT_BITS, similarity: float | None = None
) -> DataFrame:
    """The columns of ``docs`` for one row of each group: the one with the smallest id, and
    any one of the rows that repeat that id. A group without ids keeps any one row. The other
    parameters are those of ``simhash_groups``. With ``similarity``, an id that stands on rows
    of different texts keeps a row for each group that it names."""
    marked, named = _grouped(docs, id_col, text, width, bits, similarity)
    keep = named.where(F.col("component_id").isNotNull()).select(F.col("component_id").alias(id_col)).distinct()
    code, root, copied = fresh("code"), fresh("root"), fresh("text")
    clashing = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    clashing = clashing.where("low <> high").select(F.col("doc_id").alias(id_col))
    several = None
    if similarity is not None and not clashing.isEmpty():
        keep = keep.join(clashing, id_col, "left_anti")
        chosen = named.join(marked, "code").where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("code").alias(code))
        chosen = chosen.select(F.col("doc_id").alias(id_col), code)
        rows = docs.join(clashing, id_col, "left_semi").withColumn(copied, F.col(text))
        several = shingle_codes(rows, copied, code, width).join(chosen, [id_col, code], "left_semi").dropDuplicates([id_col, code])
    kept = docs.join(keep, id_col, "left_semi").select(*docs.columns)
    if not marked.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        kept = kept.dropDuplicates([id_col])
    if several is not None:
        kept = kept.unionByName(several.select(*docs.columns))
    nameless = named.where(F.col("component_id").isNull())
    if nameless.isEmpty():
        return kept
    unnamed = docs.where(F.col(id_col).isNull()).withColumn(copied, F.col(text))
    unnamed = fingerprints(unnamed, copied, code, width) if similarity is None else shingle_codes(unnamed, copied, code, width)
    roots = nameless.select(F.col("code").alias(code), F.col("root").alias(root))
    return kept.unionByName(unnamed.join(roots, code).dropDuplicates([root]).select(*docs.columns))
