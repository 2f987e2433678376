"""Long repeated passages by maximal repeats of an enhanced suffix array.

A string of LENGTH bytes is removed wherever it also starts earlier. All strings of a corpus
cannot be sorted together, so equal ones are first brought together: every string selects its
smallest 32-byte gram as anchor, equal strings select equal anchors, and all strings in a row
that select one anchor make its fragment. Equal fragments of an anchor are settled by their hashes: all
but the first are repeats. Different fragments of one anchor may still share strings; those
that do, by the hashes of their strings, are sorted as suffixes, and a stack scan over the common-prefix lengths lists the intervals
of LENGTH or more whose members differ to the left: the maximal repeats, each with all its
occurrences. All but the first occurrence go."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrift.llm.common import fresh, gives_back, slices, sorted_groups, split_hot, text_slices
from tallyrift.session import materialize

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # bytes of a string before its anchor at most
HALF = REACH // 2
GROUP_ROWS, SORTED_ROWS, PART_BYTES = 3000, 3000, 1 << 23
LAST_ID = (1 << 63) - 1
ROW = "doc_id bigint, version int, start bigint, stop bigint"

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= C2
    x ^= x >> np.uint64(29)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of eight bytes."""
    words = np.ndarray(max(len(data) - 7, 0), np.uint64, np.ascontiguousarray(data), strides=(1,))
    return _mix((words + C2) * C1)


def _double(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of runs twice as long, from those of their halves."""
    if len(h) <= step:
        return h[:0]
    out = h[:-step] * C1
    out += h[step:]
    return _mix(out)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of texts: row, start of the fragment, its shape (bytes before the anchor * 256
    + all its bytes), hash of the gram, hash of the fragment."""
    sizes = np.array([len(d) for d in docs])
    keep = np.flatnonzero(sizes >= LENGTH)
    if not len(keep):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    data = np.frombuffer(b"".join(docs[i] for i in keep), np.uint8)
    ends = np.cumsum(sizes[keep])
    starts = ends - sizes[keep]
    h = _double(_double(_eights(data), 8), 16)
    long = _double(h, GRAM)
    lowest = _slide(h, REACH + 1, np.minimum)  # of every string
    for end in ends[:-1]:
        lowest[end - LENGTH + 1 : end] = 0  # strings that would cross into the next text
    padded = np.concatenate((np.zeros(REACH, np.uint64), lowest, np.zeros(REACH, np.uint64)))
    place = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == h)
    key = h[place]
    first, last = np.zeros(len(place), np.int64), np.full(len(place), -1)
    for back in range(REACH + 1):  # strings that start so far before the anchor and select it
        chosen = padded[place + (REACH - back)] == key
        first[chosen] = back
        last[chosen & (last < 0)] = back
    row = np.searchsorted(starts, place, "right") - 1
    left, right = place - first, place - last + LENGTH
    fragment = long[left] * C1 + long[np.minimum(left + 2 * GRAM, right - 2 * GRAM)]
    fragment = _mix(fragment) * C1 + long[right - 2 * GRAM]
    shape = first * 256 + right - left
    fragment = _mix(fragment + shape.astype(np.uint64) * C2)
    return keep[row], left - starts[row], shape, key, fragment


def _merge(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching intervals of a document as one."""
    order = np.lexsort((start, version, doc))
    doc, version, start, stop = doc[order], version[order], start[order], stop[order]
    first = np.concatenate(([True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))[: len(doc)]
    span = int(stop.max()) + 2 if len(stop) else 1
    shift = np.cumsum(first) * span  # documents one after the other
    reach = np.maximum.accumulate(stop + shift)
    opens = np.concatenate(([True], start[1:] + shift[1:] > reach[:-1]))[: len(doc)]
    at = np.flatnonzero(opens)
    last = np.append(at[1:] - 1, len(doc) - 1) if len(at) else at
    return doc[at], version[at], start[at], reach[last] - shift[last]


def _removals(doc, version, start, stop) -> pa.RecordBatch:
    doc, version, start, stop = _merge(doc, version, start, stop)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(version, pa.int32()), pa.array(start), pa.array(stop)], ["doc_id", "version", "start", "stop"]
    )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Ids, versions and texts of runs of documents of about PART_BYTES."""
    for batch in batches:
        ids, versions = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        column = batch.column(2)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        for a, b in slices(sizes, PART_BYTES):
            yield ids[a:b], versions[a:b], column.slice(a, b - a)


@gives_back
def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of every text. Of equal fragments in one part only the first goes on; the
    others are repeats already and leave as intervals, so a passage that everybody has
    sends one row per part."""
    for ids, versions, column in _parts(batches):
        found = []
        for a, _, docs in text_slices(column):
            row, *rest = anchors(docs)
            found.append((row + a, *rest))
        row, start, shape, key, fragment = (np.concatenate(x) for x in zip(*found))
        both = _mix(key + fragment * C1)
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        twin = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
        twin = twin[np.lexsort((start[twin], versions[row[twin]], ids[row[twin]], fragment[twin], key[twin]))]
        later = twin[1:][(key[twin[1:]] == key[twin[:-1]]) & (fragment[twin[1:]] == fragment[twin[:-1]])]
        first = np.ones(len(row), bool)
        first[later] = False
        doc, version, gone, stop = _merge(ids[row[later]], versions[row[later]], start[later], start[later] + shape[later] % 256)
        row, none = row[first], len(doc)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(key[first].view(np.int64)), pa.nulls(none, pa.int64())]),
                pa.concat_arrays([pa.array(fragment[first].view(np.int64)), pa.nulls(none, pa.int64())]),
                pa.array(np.concatenate((ids[row], doc))),
                pa.array(np.concatenate((versions[row], version)), pa.int32()),
                pa.array(np.concatenate((start[first], gone))),
                pa.concat_arrays([pa.nulls(len(row), pa.int64()), pa.array(stop)]),
                pa.concat_arrays([pa.array(shape[first], pa.int32()), pa.nulls(none, pa.int32())]),
            ],
            ["key", "fragment", "doc_id", "version", "start", "stop", "shape"],
        )


@gives_back
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, fragment, document, start): later rows of a fragment are
    repeats (``stop`` is set); first rows of an anchor with several fragments are open
    (``shape`` is set). Only the last first row is held, to learn what follows it."""
    held = None  # key, fragment, doc, version, start, shape and whether its key came before

    def rows(doc, version, start, stop=None, shape=None) -> pa.RecordBatch:
        size = len(doc)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc), pa.array(version, pa.int32()), pa.array(start),
                pa.nulls(size, pa.int64()) if stop is None else pa.array(stop),
                pa.nulls(size, pa.int32()) if shape is None else pa.array(shape, pa.int32()),
            ],
            ["doc_id", "version", "start", "stop", "shape"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        key, fragment, doc, version, start, shape = columns
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (fragment[1:] != fragment[:-1])))
        if held is not None and held[0] == key[0] and held[1] == fragment[0]:
            new[0] = False
        later = ~new
        if later.any():
            yield rows(*_merge(doc[later], version[later].astype(np.int64), start[later], start[later] + shape[later] % 256))
        if not new.any():
            continue
        firsts = [x[new].astype(np.int64) for x in columns]
        before = False
        if held is not None:
            firsts = [np.concatenate(([h], x)) for h, x in zip(held[:6], firsts)]
            before = held[6]
        same = firsts[0][1:] == firsts[0][:-1]
        several = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        several[-1] = False
        held = [*(x[-1] for x in firsts), bool(same[-1]) if len(same) else before]
        if several.any():
            yield rows(*(x[several] for x in firsts[2:5]), shape=firsts[5][several])
    if held is not None and held[6]:
        yield rows([held[2]], [held[3]], [held[4]], shape=[held[5]])


@gives_back
def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around open anchors. Two fragments can share a string only if they agree on
    HALF more bytes to the left or to the right of the anchor; both are keys."""
    for batch in batches:
        doc, version = batch.column(0), batch.column(1)
        found: list[tuple] = []
        asked = ((a + i, t, p) for a, b, docs in text_slices(batch.column(2)) for i, (t, p) in enumerate(zip(docs, batch.column(3).slice(a, b - a).to_pylist())))
        for row, text, places in asked:
            for start, shape in ((p["start"], p["shape"]) for p in places or ()):
                at, size = divmod(shape, 256)
                data = text[start : start + size]
                if at >= HALF:
                    found.append((b"<" + data[at - HALF : at + GRAM], row, start, data))
                if len(data) - at >= GRAM + HALF:
                    found.append((b">" + data[at : at + GRAM + HALF], row, start, data))
        for a in range(0, len(found), 20_000):
            side, row, start, data = zip(*found[a : a + 20_000])
            key = [int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True) for s in side]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), doc.take(at), version.take(at), pa.array(start, pa.int64()), pa.array(data, pa.binary())],
                ["key", "doc_id", "version", "start", "data"],
            )


class SuffixArray:
    """Suffixes of at least ``least`` bytes of several fragments, sorted, with the lengths of
    the common prefixes of neighbours. Suffixes end with their fragment. With ``repeated``
    those whose first ``least`` bytes are nowhere else (by hash) are left out."""

    def __init__(self, data: list[bytes], least: int = LENGTH, repeated: bool = False):
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        # bytes from 1 on, so that zero stands for the end; 255 never occurs in UTF-8
        text = np.frombuffer(b"".join(data) + bytes(int(sizes.max(initial=0))), np.uint8) + np.uint8(1)
        self.begin = ends - sizes
        self.fragment = np.repeat(np.arange(len(data)), sizes)
        remain = ends[self.fragment] - np.arange(len(self.fragment))
        starts = np.flatnonzero(remain >= least)
        sort = self._sort_repeated if repeated else self._sort_all
        self.suffix, self.common = sort(text, starts, remain, least, int(sizes.max(initial=1))) if len(starts) else (starts, starts)
        before = text[self.suffix - 1].astype(np.int64)
        at_start = self.suffix == self.begin[self.fragment[self.suffix]]
        self.before = np.where(at_start, -1 - np.arange(len(self.suffix)), before)  # unknown differs from all

    @staticmethod
    def _sort_all(text: np.ndarray, starts: np.ndarray, remain: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        left = remain[starts]
        suffixes = text[starts[:, None] + np.arange(width)]
        suffixes[np.arange(width) >= left[:, None]] = 0
        order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{width}").ravel(), kind="stable")
        suffixes, left = suffixes[order], left[order]
        differs = suffixes[1:] != suffixes[:-1]
        common = np.where(differs.any(1), differs.argmax(1), width)
        return starts[order], np.minimum(common, np.minimum(left[1:], left[:-1]))

    @staticmethod
    def _sort_repeated(text: np.ndarray, starts: np.ndarray, remain: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes that share their first ``least`` bytes side by side, sorted by what follows,
        a word of eight bytes at a time and only where still equal. In which order different
        beginnings come is of no interest: they share nothing of that length."""
        if least < 8:
            raise ValueError("strings of eight bytes at least")
        h, step = _eights(text), 8
        while 2 * step <= least:
            h = _double(h, step)
            step *= 2
        head = _mix(h[starts] * C1 + h[starts + least - step])
        order = np.argsort(head, kind="stable")
        same = head[order[1:]] == head[order[:-1]]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        starts, head = starts[order][twice], head[order][twice]
        if not len(starts):
            return starts, starts
        same = np.concatenate(([False], head[1:] == head[:-1]))
        words = np.ndarray(max(len(text) - 7, 0), ">u8", np.ascontiguousarray(text), strides=(1,))
        left = remain[starts] - least
        rest = []
        for at in range(0, width - least, 8):
            there = np.clip(left - at, 0, 8).astype(np.uint64)
            word = words[np.minimum(starts + least + at, len(words) - 1)].astype(np.uint64)
            rest.append(np.where(there > 0, word & ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(there, np.uint64(1))), np.uint64(0)))
        group = np.cumsum(~same)
        place = np.arange(len(starts))
        for word in rest:
            tied = np.concatenate((group[1:] == group[:-1], [False]))
            tied = np.flatnonzero(tied | np.concatenate(([False], tied[:-1])))
            if not len(tied):
                break
            order = np.lexsort((word[place[tied]], group[tied]))
            place[tied] = place[tied][order]
            value = word[place]
            group = np.cumsum(np.concatenate(([True], (group[1:] != group[:-1]) | (value[1:] != value[:-1]))))
        starts, left, head = starts[place], left[place], np.cumsum(~same)  # beginnings stay where they are
        joined = np.flatnonzero(head[1:] == head[:-1])
        one, two = starts[joined], starts[joined + 1]
        equal = np.ones(len(joined), bool)
        for at in [*range(0, least - 7, 8), least - 8]:  # the bytes themselves, not their hash
            equal &= words[one + at] == words[two + at]
        length, going = np.full(len(joined), least), equal.copy()
        for word in rest:
            apart = word[place[joined]] ^ word[place[joined + 1]]
            shared = sum((apart >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 9))
            length += np.where(going, shared, 0)
            going &= shared == 8
        length = np.minimum(length, least + np.minimum(left[joined], left[joined + 1]))
        common = np.zeros(len(starts) - 1, np.int64)
        common[joined] = np.where(equal, length, 0)
        return starts, common

    def repeat_table(self, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``length, first, last`` (places in ``suffix``) of every interval of the common
        prefix tree with at least ``least`` bytes whose members differ to the left. A run of
        one length is one interval; only runs of several lengths need the stack."""
        common, before = self.common, self.before
        deep = np.flatnonzero(common >= least)
        if not len(deep):
            return deep, deep, deep
        change = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
        opens = np.flatnonzero(np.concatenate(([True], np.diff(deep) > 1)))
        first, last = deep[opens], deep[np.append(opens[1:], len(deep)) - 1] + 1
        flat = np.maximum.reduceat(common[deep], opens) == np.minimum.reduceat(common[deep], opens)
        found = [(int(n), a, b) for start, stop in zip(first[~flat].tolist(), last[~flat].tolist()) for n, a, b in self._scanned(start, stop, change)]
        one = flat & (change[first] != change[last])
        more = np.array(found, np.int64).reshape(-1, 3)
        return tuple(np.concatenate(x) for x in zip((common[first[one]], first[one], last[one]), more.T))

    def maximal_repeats(self, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
        yield from zip(*(x.tolist() for x in self.repeat_table(least)))

    def _scanned(self, start: int, stop: int, change: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Intervals of a run of suffixes whose neighbours all share enough."""
        stack: list[tuple[int, int]] = []  # length and first place of open intervals
        for i, length in enumerate(self.common[start:stop].tolist(), start):
            first = i
            while stack and stack[-1][0] > length:
                top, first = stack.pop()
                if change[i] != change[first]:
                    yield top, first, i
            if not stack or stack[-1][0] < length:
                stack.append((length, first))
        yield from self._closed(stack, stop, 0, change)

    @staticmethod
    def _closed(stack, last, length, change) -> Iterator[tuple[int, int, int]]:
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            if change[last] != change[first]:
                yield top, first, last


@gives_back
def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in sorted_groups(batches, "key", SORTED_ROWS):
        keys = rows.column("key").to_numpy()
        start = np.concatenate(([True], keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(np.flatnonzero(start), len(keys)))
        rows = rows.filter(pa.array(np.repeat(sizes > 1, sizes)))
        if not rows.num_rows:
            continue
        doc, version, begin = (rows.column(c).to_numpy() for c in ("doc_id", "version", "start"))
        array = SuffixArray(rows.column("data").to_pylist(), repeated=True)
        member = array.fragment[array.suffix]
        place = begin[member] + array.suffix - array.begin[member]
        order = np.empty(len(place), np.int64)
        by = np.lexsort((place, version[member], doc[member]))
        moved = np.concatenate(([False], np.diff(place[by]) != 0)) if len(by) else np.empty(0, bool)
        if len(by):
            d, v = doc[member][by], version[member][by]
            moved[1:] |= (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        order[by] = np.cumsum(moved)  # equal for the same place of the same document
        length, first, last = array.repeat_table()
        if len(length):
            sizes = last - first + 1
            opens = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) - np.repeat(opens - first, sizes)  # all members of all intervals
            later = order[at] > np.repeat(np.minimum.reduceat(order[at], opens), sizes)
            at, length = at[later], np.repeat(length, sizes)[later]
            yield _removals(doc[member[at]], version[member[at]].astype(np.int64), place[at], place[at] + length)


def _versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``doc_id, text`` and more) plus ``_id`` and ``version``, and each pair of the
    two once. Rows that repeat id and text are one document and get one result each; texts
    that share an id are told apart by their version, in the order of their hashes. A null
    id comes last."""
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(LAST_ID)))
    twice = materialize(rows.groupBy("_id").count().where("count > 1").select("_id"), "twice")
    if twice.isEmpty():
        rows = rows.withColumn("version", F.lit(0))
        return rows, rows
    hashed = rows.withColumn("_hash", F.xxhash64("text"))
    order = Window.partitionBy("_id").orderBy("_hash")
    known = hashed.join(twice, "_id", "left_semi").select("_id", "_hash").distinct()
    known = materialize(known.withColumn("version", F.row_number().over(order) - 1), "versions")
    rows = hashed.join(known, ["_id", "_hash"], "left").withColumn("version", F.coalesce("version", F.lit(0))).drop("_hash")
    repeated = rows.join(twice, "_id", "left_semi").dropDuplicates(["_id", "version"])
    return rows, rows.join(twice, "_id", "left_anti").unionByName(repeated)


def repeat_intervals(rows: DataFrame) -> DataFrame:
    """``doc_id, version, start, stop`` of removed bytes; intervals may overlap and end
    behind the text. ``rows`` has ``doc_id, version, text``."""
    found = rows.mapInArrow(_anchor_rows, f"key bigint, fragment bigint, {ROW}, shape int")
    found = materialize(found, "anchors")
    anchor = found.where("key is not null").drop("stop").repartition("key")
    anchor = anchor.sortWithinPartitions("key", "fragment", "doc_id", "version", "start")
    settled = materialize(anchor.mapInArrow(_settle, f"{ROW}, shape int"), "settled")
    asked = settled.where("stop is null").groupBy("doc_id", "version").agg(F.collect_set(F.struct("start", "shape")).alias("places"))
    with_text = rows.join(asked, ["doc_id", "version"]).select("doc_id", "version", "text", "places")
    pieces = with_text.mapInArrow(_fragments, "key bigint, doc_id bigint, version int, start bigint, data binary")
    pieces = materialize(pieces, "fragments")
    pieces = split_hot(pieces, "key", GROUP_ROWS, F.xxhash64("doc_id", "version", "start"), "hot")
    sorted_ = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_repeats, ROW)
    parts = [found.where("key is null"), settled.where("stop is not null"), sorted_]
    columns = ["doc_id", "version", "start", "stop"]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


def _cut(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """Kept bytes, removed bytes and removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for start, stop in sorted((s["start"], min(s["stop"], len(text))) for s in spans or ()):
        if not runs or start > at:
            kept.append(text[at:start])
            removed += stop - start
            runs, at = runs + 1, stop
        elif stop > at:
            removed += stop - at
            at = stop
    kept.append(text[at:])
    return b"".join(kept), removed, runs


@gives_back
def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the text and its spans; the others pass."""
    for batch in batches:
        spans = batch.column(batch.num_columns - 1)
        for a, b, docs in text_slices(batch.column(batch.num_columns - 2)):
            kept, removed, runs = zip(*map(_cut, docs, spans.slice(a, b - a).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.slice(a, b - a) for c in batch.columns[:-2]),
                    pa.array([len(d) for d in docs], pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                    pa.array([k.decode("utf-8", "ignore") for k in kept]),
                ],
                [*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, ``kept`` (the
    remaining bytes as text; bytes of characters that were cut apart go too) and the columns
    named in ``keep``. Null texts are empty. Rows that repeat id and text are one document
    and share its result; a null id comes after all others. No rows give no rows."""
    named = {c: fresh("kept") for c in keep or ()}
    rows, single = _versions(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in named.items())))
    found = repeat_intervals(single.select(F.col("_id").alias("doc_id"), "version", "text"))
    spans = found.groupBy(F.col("doc_id").alias("_id"), "version").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    body = rows.join(spans, ["_id", "version"], "left").select("doc_id", *named.values(), "text", "spans")
    passed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields[:-2])
    done = body.mapInArrow(_applied, f"{passed}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    return done.withColumnsRenamed({n: c for c, n in named.items()}) if named else done
