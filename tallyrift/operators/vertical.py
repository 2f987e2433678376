"""Counting itemsets by vertical bitmaps.

A block of transactions becomes one bitmap per item: which transactions hold it. The wanted
itemsets form a prefix tree that is walked once per block, so that itemsets with a common
beginning share its work, and all children of a node are computed in one step. Where
children hold most of their parent's transactions, the walk goes on with the differences to
the parent instead, which are nearly empty; words that have become empty are left out on the
way down. A count is a popcount, weighted by the bits of the weights; what leaves a task is
one row per itemset (and target value) and block, never a row per match.

The functions here run inside tasks over Arrow batches and know no Spark session."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

BLOCK_ROWS = 1 << 16
BLOCK_BITS = 1 << 26  # items times transactions of a block
HELD_PAIRS = 1 << 21
MOSTLY = 0.5

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


@dataclass
class Node:
    """A prefix of wanted itemsets; ``key`` if it is one itself. ``below`` are the items of all
    longer itemsets with this prefix, ascending."""

    key: int = -1
    children: dict[int, Node] = field(default_factory=dict)
    below: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def prefix_tree(sets: Iterable[tuple[int, Iterable[int]]]) -> Node:
    """The tree of ``key, sorted items`` pairs."""
    root = Node()
    for key, items in sets:
        node = root
        for item in items:
            node = node.children.setdefault(item, Node())
        node.key = key
    _note_items(root)
    return root


def _note_items(root: Node) -> None:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children.values())
    for node in reversed(order):
        items = set(node.children)
        for child in node.children.values():
            items.update(child.below.tolist())
        node.below = np.array(sorted(items), np.int64)


@dataclass
class Block:
    """Transactions as numbers: items of all rows in one array, row starts, targets, weights."""

    items: np.ndarray
    starts: np.ndarray  # one more than rows
    targets: np.ndarray
    weights: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.weights)

    def part(self, start: int, stop: int) -> Block:
        at = self.starts[start : stop + 1]
        return Block(self.items[at[0] : at[-1]], at - at[0], self.targets[start:stop], self.weights[start:stop])


def blocks(batches: Iterable[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[Block]:
    """Blocks of about ``rows`` transactions from batches of ``ids, target, weight``."""

    def joined() -> Block:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("ids").chunk(0)
        starts = ids.offsets.to_numpy().astype(np.int64)
        items = ids.values.to_numpy()[starts[0] : starts[-1]]
        return Block(items, starts - starts[0], *(table.column(c).to_numpy() for c in ("target", "weight")))

    held, count = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            yield joined()
            held, count = [], 0
    if held:
        yield joined()


class Bitmaps:
    """Bitmaps of ``items`` (ascending) over a block, a row of 64-bit words per item."""

    def __init__(self, block: Block, items: np.ndarray):
        self.items, self.words = items, max(1, -(-block.rows // 64))
        place = np.searchsorted(items, block.items)
        known = place < len(items)
        known[known] = items[place[known]] == block.items[known]
        row = np.repeat(np.arange(block.rows), np.diff(block.starts))[known]
        bits = np.zeros((len(items), self.words * 64), bool)
        bits[place[known], row] = True
        self.bits = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        full = np.zeros(self.words * 64, bool)
        full[: block.rows] = True
        self.full = np.packbits(full, bitorder="little").view(np.uint64)

    def of(self, items: np.ndarray) -> np.ndarray:
        return self.bits[np.searchsorted(self.items, items)]


class Weights:
    """Sums of weights over bitmaps: popcounts with each binary digit of the weights."""

    def __init__(self, block: Block, words: int):
        weights = block.weights.astype(np.uint64)
        self.same = int(weights[0]) if (weights == weights[0]).all() else None
        self.planes = []
        if self.same is None:
            for digit in range(int(weights.max()).bit_length()):
                plane = np.zeros(words * 64, bool)
                plane[: len(weights)] = weights >> np.uint64(digit) & np.uint64(1) == 1
                self.planes.append(np.packbits(plane, bitorder="little").view(np.uint64))

    def sums(self, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of weights per row of ``bits``, whose columns are the words ``at``."""
        if self.same is not None:
            return np.bitwise_count(bits).sum(1, dtype=np.int64) * self.same
        total = np.zeros(len(bits), np.int64)
        for digit, plane in enumerate(self.planes):
            total += np.bitwise_count(bits & plane[at]).sum(1, dtype=np.int64) << digit
        return total


class Targets:
    """Sums of weights per target value over bitmaps."""

    def __init__(self, block: Block, words: int):
        self.values, code = np.unique(block.targets, return_inverse=True)
        self.code = np.zeros(words * 64, np.int64)
        self.code[: block.rows] = code
        self.weight = np.zeros(words * 64)
        self.weight[: block.rows] = block.weights

    def sums(self, bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = np.zeros((len(bits), len(self.values)), np.int64)
        for row, word in enumerate(bits):
            used = np.flatnonzero(word)
            inside = np.flatnonzero(np.unpackbits(word[used].view(np.uint8), bitorder="little"))
            place = at[used[inside >> 6]] * 64 + (inside & 63)
            found[row] = np.bincount(self.code[place], self.weight[place], len(self.values))
        return found


def _filled(bits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the words that are empty in all rows, if these are half of them."""
    used = bits.any(0)
    if 2 * used.sum() > len(used):
        return bits, at
    return bits[:, used], at[used]


def walk(block: Block, root: Node, by_target: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """``key, sums`` of every wanted itemset that the block holds: the sum of weights, or the
    sums per target value."""
    step = max(64, BLOCK_BITS // max(1, len(root.below)))
    for start in range(0, block.rows, step):
        part = block.part(start, min(start + step, block.rows))
        present = np.intersect1d(root.below, np.unique(part.items), assume_unique=True)
        maps = Bitmaps(part, present)
        gauge = Targets(part, maps.words) if by_target else Weights(part, maps.words)
        for key, sums in _walked(root, maps, gauge):
            yield key, (gauge.values, sums) if by_target else sums


def sums_in(block: Block, root: Node, by_target: bool = False) -> pa.RecordBatch:
    """``walk`` as rows ``at, n`` or ``at, target, n``, without zeros."""
    keys, targets, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for key, value in walk(block, root, by_target):
        if by_target:
            inside = np.flatnonzero(value[1])
            targets.append(value[0][inside])
            sums.append(value[1][inside])
            keys.append(np.full(len(inside), key))
        elif value:
            keys.append(np.array([key]))
            sums.append(np.array([value]))
    columns = {"at": keys, "target": targets, "n": sums} if by_target else {"at": keys, "n": sums}
    return pa.RecordBatch.from_pydict({name: np.concatenate(part).astype(np.int64) for name, part in columns.items()})


def _walked(root: Node, maps: Bitmaps, gauge) -> Iterator[tuple[int, np.ndarray]]:
    known = set(maps.items.tolist())
    at = np.arange(maps.words)
    for item, node in root.children.items():
        if item not in known:
            continue
        own = maps.of(np.array([item]))
        sums = gauge.sums(own, at)[0]
        if node.key >= 0:
            yield node.key, sums
        if not node.children:
            continue
        below = node.below[np.isin(node.below, maps.items, assume_unique=True)]
        if len(below):
            yield from _class(node, below, *_beginning(own[0], maps.of(below), at), sums, gauge)


def _beginning(own: np.ndarray, others: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """The transactions that an item shares with others, or those they lack, whichever are fewer."""
    used = own != 0
    own, others, at = own[used], others[:, used], at[used]
    both = others & own
    held = np.bitwise_count(both).sum() > MOSTLY * len(others) * np.bitwise_count(own).sum()
    return (own & ~others, at, True) if held else (both, at, False)


def _class(node: Node, items: np.ndarray, bits: np.ndarray, at: np.ndarray, lacking: bool, sums: np.ndarray, gauge) -> Iterator[tuple[int, np.ndarray]]:
    """Itemsets below ``node``, whose transactions weigh ``sums``. ``bits`` has a row per item:
    those of the node's transactions that hold the item, or lack it."""
    bits, at = _filled(bits, at)
    rows = [row for row, item in enumerate(items.tolist()) if item in node.children]
    for row, found in zip(rows, gauge.sums(bits[rows], at)) if rows else ():
        child = node.children[int(items[row])]
        found = sums - found if lacking else found
        if not found.any():
            continue
        if child.key >= 0:
            yield child.key, found
        if child.children:
            later = np.flatnonzero(np.isin(items, child.below, assume_unique=True))
            if len(later):
                # lacking one more: not what the child lacks already; holding one more: both
                next_bits = bits[later] & ~bits[row] if lacking else bits[later] & bits[row]
                yield from _class(child, items[later], next_bits, at, lacking, found, gauge)


def held_pairs(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``first * width + second`` of all pairs that transactions hold, and their weights, each
    pair once. Few items are met by bitmaps, many by lining each row up with itself shifted."""
    lengths = np.diff(block.starts)
    total = int((lengths * (lengths - 1) // 2).sum())
    items = np.unique(block.items).astype(np.int64)
    if len(items) * (len(items) * (block.rows / 64) + 32) < 4 * total and len(items) * block.rows <= BLOCK_BITS:
        return _pairs_by_bitmap(block, items, width)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    row = np.repeat(np.arange(block.rows), lengths)
    first = block.items.astype(np.int64)
    held = 0
    for shift in range(1, int(lengths.max(initial=0))):
        same = row[shift:] == row[:-shift]
        keys = first[:-shift][same] * width + first[shift:][same]
        found.append((keys, block.weights[row[shift:][same]]))
        held += len(keys)
        if held > HELD_PAIRS:
            found = [merged(found)]
            held = len(found[0][0])
    return merged(found)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, np.concatenate([n for _, n in parts]))
    return keys, total


def _pairs_by_bitmap(block: Block, items: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    maps = Bitmaps(block, items)
    gauge, at = Weights(block, maps.words), np.arange(maps.words)
    keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in range(len(items) - 1):
        used = maps.bits[row] != 0
        n = gauge.sums(maps.bits[row + 1 :, used] & maps.bits[row, used], at[used])
        keys.append(items[row] * width + items[row + 1 :][n > 0])
        sums.append(n[n > 0])
    return np.concatenate(keys), np.concatenate(sums)
