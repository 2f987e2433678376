"""Class-based language model: words get classes by exchange, a text's probability is the
product of class transitions and of words given their class.

1. Words of all training texts are counted. The CORE most frequent are the core words.
2. Texts become runs of numbers (chunks of about CHUNK_BYTES of text): a core word its rank,
   any other word its place among the chunk's own words.
3. Neighbouring core words are counted (at most CORE squared pairs), and exchange moves every
   core word to the class that raises the likelihood most, a random half of the words at a
   time against the classes of the round before. A word's contexts stay in one row.
4. Every other word meets its occurrences in one place, makes one exchange step against the
   core's classes, and sends count and class back to the chunks that hold it.
5. Class transitions of all training texts are counted, and all texts are scored.

Nothing that grows with the vocabulary is broadcast; the driver holds CORE words and
matrices of classes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import gives_back, text_slices
from tallyrift.session import materialize

CORE = 4096
CORE_WORD_BYTES = 64  # longer words are never core words, so that the core's size has a bound
LONG = b"\xff"  # starts no word in UTF-8
CLASSES = 64
END, RARE = CLASSES, CLASSES + 1  # classes of the end and, while clustering, of all other words
WIDTH = CLASSES + 2
UNKNOWN = 255
ROUNDS = 8
CHUNK_BYTES = 16 << 20
HELD_WORDS = 1 << 18
HELD_PAIRS = 1 << 21
DISCOUNT = 0.5
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(body: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text in parts of about ``size`` bytes, cut at white space."""
    start = 0
    while start < len(body):
        cut = SPACE.search(body, start + size)
        stop = cut.start() if cut else len(body)
        yield body[start:stop]
        start = stop


def held_out(doc_id: str = "doc_id") -> Column:
    """One document in five is never learned from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 1


def short(word: bytes) -> bytes:
    """The word, or a hash of a long one: apart from the core, words are only told apart."""
    return word if len(word) <= CORE_WORD_BYTES else LONG + hashlib.sha256(word).digest()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word binary, n`` of a column of texts, A-Z in lower case; long words as ``short``."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(short, counts)), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for _, _, bodies in text_slices(batch.column(0)):
                for body in bodies:
                    for piece in pieces(body):
                        counts.update(piece.lower().split())
                    if len(counts) > HELD_WORDS:
                        yield counted()
                        counts = Counter()
        if counts:
            yield counted()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class _Places(dict):
    """Words to numbers; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1  # one number in between is the end's
        return place


def encode(docs: DataFrame, core: list[bytes]) -> DataFrame:
    """Chunks: ``chunk, ids, held, lengths, codes, words``. A code below the core's size is a
    core word, the core's size the end of a text, above it a word of ``words``."""
    kind, size = docs.schema["doc_id"].dataType.simpleString(), len(core)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {word: place for place, word in enumerate(core)}
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, lengths, codes, places, taken, types = [], [], [], [], _Places(known), 0, []

        def chunk() -> pa.RecordBatch:
            words = [short(word) for word in list(places)[size:]]
            body = np.concatenate(codes).astype("<u4").tobytes()
            arrays = [
                pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(types[0])), pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([body], pa.binary()), pa.array([words], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "ids", "held", "lengths", "codes", "words"])

        for batch in batches:
            types = [batch.schema.field(0).type]
            doc_ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, _, bodies in text_slices(batch.column(2)):
                for row, body in enumerate(bodies, at):
                    length = 1
                    for piece in pieces(body):
                        words = piece.lower().split()
                        codes.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
                        length += len(words)
                    codes.append(np.array([size], np.uint32))
                    ids.append(doc_ids[row])
                    held.append(flags[row])
                    lengths.append(length)
                    taken += len(body)
                    if taken >= CHUNK_BYTES:
                        yield chunk()
                        ids, held, lengths, codes, places, taken, made = [], [], [], [], _Places(known), 0, made + 1
        if ids:
            yield chunk()

    schema = f"chunk bigint, ids array<{kind}>, held array<boolean>, lengths array<bigint>, codes binary, words array<binary>"
    return docs.select("doc_id", held_out().alias("held"), "text").mapInArrow(run, schema)


def _chunk(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a chunk, and which of them are learned from. Every text ends with the end, so
    the code before a text's first word is an end as well."""
    lengths = np.array(row["lengths"], np.int64)
    return np.frombuffer(row["codes"], "<u4").astype(np.int64), np.repeat(~np.array(row["held"], bool), lengths)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _pair_counts(chunks: DataFrame, size: int) -> DataFrame:
    """``first, second, n`` of neighbouring codes in training texts; all words outside the
    core are one number."""

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)

    def batch_of(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array((key // (size + 2)).astype(np.int32)), pa.array((key % (size + 2)).astype(np.int32)), pa.array(n)]
        return pa.RecordBatch.from_arrays(arrays, ["first", "second", "n"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in _rows(batches):
            codes, learned = _chunk(row)
            codes = np.minimum(codes, size + 1)
            before = np.concatenate(([size], codes[:-1]))
            key, n = np.unique((before * (size + 2) + codes)[learned], return_counts=True)
            key, n = merged([*keys, key], [*counts, n])
            keys, counts = [key], [n]
            if len(key) > HELD_PAIRS:
                yield batch_of(key, n)
                keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(keys[0]):
            yield batch_of(keys[0], counts[0])

    slim = chunks.select("lengths", "held", "codes")
    return slim.mapInArrow(run, "first int, second int, n bigint").groupBy("first", "second").agg(F.sum("n").alias("n"))


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(matrix: np.ndarray) -> float:
    """The part of the class model's log likelihood that depends on the classes."""
    return float(_x_log_x(matrix).sum() - _x_log_x(matrix.sum(0)).sum() - _x_log_x(matrix.sum(1)).sum())


def exchange_gains(matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: float) -> np.ndarray:
    """What each class gains by taking a word in, once the word has left class ``own``.

    ``after`` and ``before`` count the word's neighbours by class, the word itself
    (``itself`` times) included."""
    rest = matrix.astype(float).copy()
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] += itself
    after, before = after.astype(float).copy(), before.astype(float).copy()
    after[own] -= itself
    before[own] -= itself
    rows, columns = rest[:CLASSES], rest[:, :CLASSES].T
    gain = (_x_log_x(rows + after) - _x_log_x(rows)).sum(1) + (_x_log_x(columns + before) - _x_log_x(columns)).sum(1)
    at = np.arange(CLASSES)
    inner, to, fro = rest[at, at], after[:CLASSES], before[:CLASSES]
    gain -= _x_log_x(inner + to) + _x_log_x(inner + fro) - 2 * _x_log_x(inner)
    gain += _x_log_x(inner + to + fro + itself) - _x_log_x(inner)
    # a class is followed and preceded by the word as often wherever the word is
    out, into = rest.sum(1)[:CLASSES] + before[:CLASSES], rest.sum(0)[:CLASSES] + after[:CLASSES]
    gain -= _x_log_x(out + after.sum() + itself) - _x_log_x(out)
    return gain - (_x_log_x(into + before.sum() + itself) - _x_log_x(into))


def _vectors(word: int, ahead: np.ndarray, other: np.ndarray, n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Neighbours by class behind and before a word, and how often it follows itself."""
    kind = classes[other]
    after = np.bincount(kind[ahead], n[ahead], WIDTH)
    before = np.bincount(kind[~ahead], n[~ahead], WIDTH)
    return after, before, float(n[ahead & (other == word)].sum())


def exchange(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the core words (the end and all others follow, with their own), and the
    counts of class pairs. ``pairs`` is a stored table ``first, second, n``."""
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("first").alias("word"), F.lit(True).alias("ahead"), F.col("second").alias("other"), "n"),
        F.struct(F.col("second").alias("word"), F.lit(False).alias("ahead"), F.col("first").alias("other"), "n"),
    )))
    contexts = materialize(both.groupBy("word").agg(F.collect_list(F.struct("ahead", "other", "n")).alias("pairs")), "contexts")

    def matrix_of(classes: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(WIDTH * WIDTH)
            for batch in batches:
                first, second, n = (batch.column(c).to_numpy() for c in range(3))
                total += np.bincount(classes[first] * WIDTH + classes[second], n, WIDTH * WIDTH)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

        found = np.zeros(WIDTH * WIDTH)
        for row in pairs.mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            found[row["at"]] = row["n"]
        return found.reshape(WIDTH, WIDTH)

    def moves(classes: np.ndarray, matrix: np.ndarray, turn: int) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, found = batch.column(1), []
                stops = np.cumsum(pc.list_value_length(lists).to_numpy())
                held = lists.flatten()
                ahead, other, n = (held.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                for word, start, stop in zip(batch.column(0).to_pylist(), [0, *stops], stops):
                    if word < size and (word * 2654435761 >> 8) + turn & 1:
                        own, here = classes[word], slice(start, stop)
                        gains = exchange_gains(matrix, own, *_vectors(word, ahead[here], other[here], n[here], classes))
                        best = int(gains.argmax())
                        if gains[best] > gains[own] + 1e-6:
                            found.append((word, best))
                word, best = zip(*found) if found else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(best, pa.int32())], ["word", "best"])

        return contexts.mapInArrow(run, "word int, best int").collect()

    classes = np.concatenate((np.arange(size) % CLASSES, [END, RARE]))
    matrix = matrix_of(classes)
    best = likelihood(matrix), classes, matrix
    for turn in range(ROUNDS):
        moved = moves(classes, matrix, turn)
        classes = classes.copy()
        for word, to in moved:
            classes[word] = to
        matrix = matrix_of(classes)
        if likelihood(matrix) > best[0]:
            best = likelihood(matrix), classes, matrix
        if not moved:
            break
    return best[1], best[2]


def _contexts_of_others(chunks: DataFrame, size: int, classes: np.ndarray) -> DataFrame:
    """``word, chunk, place, n, at, times`` of all words outside the core: how often a chunk's
    training texts hold them, and the classes of core words (and ends) before (0 on) and
    after (WIDTH on) them."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            codes, learned = _chunk(row)
            where = np.flatnonzero((codes > size) & learned)
            place, count = codes[where] - size - 1, len(row["words"])
            keys = []
            for side, neighbour in ((0, np.concatenate(([size], codes[:-1]))[where]), (1, np.concatenate((codes[1:], [size]))[where])):
                core = neighbour <= size
                keys.append(place[core] * (2 * WIDTH) + side * WIDTH + classes[neighbour[core]])
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(count + 1) * (2 * WIDTH)).astype(np.int32))
            n = np.bincount(place, minlength=count).astype(np.int64)
            arrays = [
                pa.array(row["words"], pa.binary()), pa.array(np.full(count, row["chunk"])), pa.array(np.arange(count, dtype=np.int32)), pa.array(n),
                pa.ListArray.from_arrays(offsets, pa.array((key % (2 * WIDTH)).astype(np.int16))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "chunk", "place", "n", "at", "times"])

    return chunks.select("chunk", "held", "lengths", "codes", "words").mapInArrow(
        run, "word binary, chunk bigint, place int, n bigint, at array<smallint>, times array<int>"
    )


def smoothed(matrix: np.ndarray) -> np.ndarray:
    """P(second | first): absolute discounting, backed by the frequency of the second."""
    width = len(matrix)
    backed = (matrix.sum(0) + 0.5) / (matrix.sum() + 0.5 * width)
    total = matrix.sum(1, keepdims=True)
    seen = (matrix > 0).sum(1, keepdims=True)
    found = (np.maximum(matrix - DISCOUNT, 0) + DISCOUNT * seen * backed) / np.maximum(total, 1)
    return np.where(total > 0, found, backed)


def _classes_of_others(contexts: DataFrame, matrix: np.ndarray) -> DataFrame:
    """``chunk, place, n, kind, lead``: count in all training texts and class of each word, for
    every chunk that holds it; one row of a learned word leads. The class is the one whose
    transitions and size make the word's occurrences most likely."""
    change = np.log(smoothed(matrix))
    taken = np.log(matrix.sum(0)[:CLASSES] + 1)
    weights = np.concatenate((change[:, :CLASSES], change[:CLASSES].T))  # before, after

    def decided(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        word = rows.column("word").chunk(0)
        new = np.concatenate(([True], pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)))
        group = np.cumsum(new) - 1
        at, times = rows.column("at").chunk(0), rows.column("times").chunk(0)
        here = np.repeat(group, pc.list_value_length(at).to_numpy(zero_copy_only=False))
        seen = np.bincount(here * (2 * WIDTH) + at.flatten().to_numpy(), times.flatten().to_numpy(), (group[-1] + 1) * 2 * WIDTH)
        n = np.bincount(group, rows.column("n").to_numpy())
        kind = (seen.reshape(-1, 2 * WIDTH) @ weights - n[:, None] * taken).argmax(1)
        n = n.astype(np.int64)[group]
        arrays = [rows.column("chunk").chunk(0), rows.column("place").chunk(0), pa.array(n), pa.array(kind[group].astype(np.int32)), pa.array(new & (n > 0))]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "place", "n", "kind", "lead"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch])
            held = here if held is None else pa.concat_tables([held, here])
            word = held.column("word").combine_chunks()
            last = word[len(word) - 1]
            size = pc.sum(pc.equal(word, last)).as_py()  # the last word may go on
            if size < len(word):
                yield decided(held.slice(0, len(word) - size))
                held = held.slice(len(word) - size)
        if held is not None:
            yield decided(held)

    return contexts.repartition("word").sortWithinPartitions("word").mapInArrow(run, "chunk bigint, place int, n bigint, kind int, lead boolean")


def _read(chunks: DataFrame, others: DataFrame, core_n: np.ndarray, classes: np.ndarray, ends: int, log_base: float, stay: np.ndarray, total: np.ndarray) -> DataFrame:
    """Per text ``doc_id, held_out, n_tokens, n_known, base_score, emitted, kinds``: its sum of
    words given their class (unknown ones apart) and its classes, a byte a token."""
    size, kind = len(core_n), chunks.schema["ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "kinds"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        codes, _ = _chunk(row)
        n, own = np.zeros(size + 1 + row["words"], np.int64), np.full(size + 1 + row["words"], END)
        n[:size], n[size], own[:size] = core_n, ends, classes[:size]
        place = right.column("place").to_numpy() + size + 1
        n[place], own[place] = right.column("n").to_numpy(), right.column("kind").to_numpy()
        base = np.log10(n + 0.5) - log_base
        with np.errstate(divide="ignore"):
            given = np.where(n > 0, stay[own] + np.log10(np.maximum(n, 1)) - np.log10(np.maximum(total[own], 1)), 0.0)
        own = np.where(n > 0, own, UNKNOWN).astype(np.uint8)
        own[size] = END  # also where nothing was learned
        lengths = np.array(row["lengths"], np.int64)
        stops = np.cumsum(lengths)
        starts = stops - lengths
        seen, kinds = own[codes].tobytes(), []
        for start, stop in zip(starts, stops):
            kinds.append(seen[start:stop])
        arrays = [
            pa.array(row["ids"], left.schema.field("ids").type.value_type), pa.array(row["held"]), pa.array(lengths),
            pa.array(np.add.reduceat((n > 0)[codes].astype(np.int64), starts)), pa.array(np.add.reduceat(base[codes], starts)),
            pa.array(np.add.reduceat(given[codes], starts)), pa.array(kinds, pa.binary()),
        ]
        return pa.Table.from_arrays(arrays, names)

    slim = chunks.select("chunk", "ids", "held", "lengths", "codes", F.size("words").alias("words"))
    return slim.groupBy("chunk").cogroup(others.select("chunk", "place", "n", "kind").groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emitted double, kinds binary"
    )


def _transitions(texts: DataFrame) -> np.ndarray:
    """Counts of class pairs in training texts, an end before the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((END + 1) ** 2, np.int64)
        for batch in batches:
            for body in batch.column(0):
                kinds = np.frombuffer(body.as_buffer(), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate(([END], kinds[:-1])) * (END + 1) + kinds, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    found = np.zeros((END + 1) ** 2)
    counted = texts.where("not held_out").select("kinds").mapInArrow(run, "at bigint, n bigint")
    for row in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():
        found[row["at"]] = row["n"]
    return found.reshape(END + 1, END + 1)


def _scored(texts: DataFrame, change: np.ndarray, unseen: np.ndarray) -> DataFrame:
    """``doc_id .. score``. An unknown word takes the class that makes it most likely after
    the class before, so the score is that of one way through the classes."""
    steps = np.log10(change)
    new = steps[:, :END] + unseen[:END]
    follow, cost = new.argmax(1), new.max(1)
    columns = [c for c in texts.columns if c not in ("emitted", "kinds")]
    kinds_at, emitted_at = len(columns) + 1, len(columns)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for at, body in enumerate(batch.column(kinds_at)):
                kinds = np.frombuffer(body.as_buffer(), np.uint8).astype(np.int64)
                unknown = np.flatnonzero(kinds == UNKNOWN)
                if len(unknown):
                    kinds = kinds.copy()
                    for place in unknown:
                        kinds[place] = follow[kinds[place - 1] if place else END]
                before = np.concatenate(([END], kinds[:-1]))
                value = steps[before, kinds]
                value[unknown] = cost[before[unknown]]
                found[at] = value.sum()
            score = pc.add(batch.column(emitted_at), pa.array(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:emitted_at], score], [*columns, "score"])

    schema = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in columns)
    return texts.select(*columns, "emitted", "kinds").mapInArrow(run, f"{schema}, score double")


def class_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    A null text is empty and has one token, its end; a null id belongs to training; repeated
    rows are learned and scored each. Where nothing was learned all words are unknown. No rows
    give no rows. Scores are decimal logarithms."""
    docs = docs.select("doc_id", "text")
    learned = docs.where(~held_out())
    counts = materialize(word_counts(learned.select("text")), "counts")
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learned.count()
    tokens, types = known[0] + ends, known[1] + (ends > 0)
    top = counts.where(F.substring("word", 1, 1) != F.lit(LONG)).orderBy(F.desc("n"), "word").limit(CORE).collect()
    core, core_n = [bytes(r.word) for r in top], np.array([r.n for r in top], np.int64)
    chunks = materialize(encode(docs, core), "chunks")
    classes, matrix = exchange(materialize(_pair_counts(chunks, len(core)), "pairs"), len(core))
    others = materialize(_classes_of_others(_contexts_of_others(chunks, len(core), classes), matrix), "others")
    total, once = np.zeros(END + 1), np.zeros(END + 1)
    np.add.at(total, classes[: len(core)], core_n)
    np.add.at(once, classes[: len(core)], core_n == 1)
    for row in others.where("lead").groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect():
        total[row["kind"]] += row["n"]
        once[row["kind"]] += row["once"]
    total[END] = ends
    unseen = (once + 0.5) / (total + 1)  # a class meets a new word as often as it met one only once
    stay = np.log10(1 - unseen)
    stay[END] = 0.0
    log_base = float(np.log10(tokens + 0.5 * (types + 1)))
    texts = materialize(_read(chunks, others, core_n, classes, ends, log_base, stay, total), "texts")
    scored = _scored(texts, smoothed(_transitions(texts)), np.log10(unseen))
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
