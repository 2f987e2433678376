"""Quality rules with n-gram perplexity.

The model is a modified Kneser-Ney model over byte n-grams. Spark counts the longest n-grams
of all documents (every task sends its own distinct n-grams once), and continuation counts,
discounts, back-off weights and probabilities follow from that table by joins and groups. For
scoring, every n-gram keeps its whole number: the table is cut into parts of about PART_GRAMS
n-grams by a one-to-one hash, and a task holds one part at a time, so its memory does not grow
with the corpus and no n-gram shares another one's probability. Bands of accepted perplexity come from the
quartiles of texts of the same language and of like length, since short texts scatter more."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import gives_back, text_slices
from tallyrift.operators.quantiles import weighted_quantiles
from tallyrift.session import materialize

ORDER, PART_GRAMS = 5, 1 << 22
SLOT_BITS = 22  # n-grams of one order that tests/llm may gather on the driver
FENCE = 1.5  # quartile distances that a document may lie outside the quartiles of its like
LIKE_ROWS = 20  # texts that quartiles of like length need; with fewer, those of the language count
LEAST_WORDS, MOST_REPEATED = 50, 50
MERGE_ROWS = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every byte, as a number, and where each text starts. Texts
    begin after ``order - 1`` zero bytes. No text may be empty."""
    pad = b"\0" * (order - 1)
    data = np.frombuffer(pad + pad.join(docs), np.uint8)
    sizes = np.array([len(d) for d in docs])
    starts = np.cumsum(sizes + order - 1) - sizes
    code = np.zeros(len(data) - order + 1, np.uint64)
    for i in range(order):
        code = code << np.uint64(8) | data[i : len(data) - order + 1 + i]
    inside = np.ones(len(code), bool)
    for i in range(order - 1):  # n-grams that end in the padding between texts
        inside[starts[1:] - order - i] = False
    return code[inside], np.cumsum(sizes) - sizes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, count = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(count, first)


def _counted(order: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def out() -> pa.RecordBatch:
            code, count = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(count)], ["gram", "n"])

        for batch in batches:
            for *_, part in text_slices(batch.column(0)):
                docs = [d for d in part if d]
                if not docs:
                    continue
                parts.append(np.unique(grams(docs, order)[0], return_counts=True))
                rows += len(parts[-1][0])
                if rows > MERGE_ROWS:
                    parts = [_merged(parts)]
                    rows = len(parts[0][0])
                    if rows > MERGE_ROWS // 2:
                        yield out()
                        parts, rows = [], 0
        if parts:
            yield out()

    return run


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    """Discounts for n-grams seen once, twice and more often."""
    n1, n2, n3, n4 = level.agg(*[F.sum((F.col("n") == k).cast("int")) for k in (1, 2, 3, 4)]).first()
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * (n3 or 0) / n2, 3 - 4 * y * (n4 or 0) / n3 if n3 else 0.9)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(found, (1, 2, 3)))


def kneser_ney(docs: DataFrame, text: str = "text", order: int = ORDER) -> list[DataFrame]:
    """``gram, n, logp, bow`` for the orders 1 to ``order``: interpolated log probability of
    the last byte after the others, and the weight that shorter n-grams get after this one."""
    levels = [materialize(docs.select(text).mapInArrow(_counted(order), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams")]
    for size in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
        levels.append(materialize(levels[-1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    levels.reverse()
    model: list[DataFrame] = []
    for size, level in enumerate(levels, 1):
        d1, d2, d3 = _discounts(level)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        before = F.shiftright("gram", 8).alias("before")
        totals = level.groupBy(before).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("left"))
        rows = level.withColumn("before", before).join(totals, "before")
        own = (F.col("n") - cut) / F.col("total")
        if size == 1:
            rows = rows.withColumn("p", own + F.col("left") / 256)
        else:
            known = model[-1].select(F.col("gram").alias("shorter"), F.exp("logp").alias("q"))
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * (size - 1)) - 1)))
            rows = rows.join(known, "shorter").withColumn("p", own + F.col("left") * F.col("q"))
            weights = totals.select(F.col("before").alias("gram"), F.log("left").alias("bow"))
            model[-1] = model[-1].join(weights, "gram", "left")
        model.append(materialize(rows.select("gram", "n", F.log("p").alias("logp")), "model"))
    model[-1] = model[-1].withColumn("bow", F.lit(None).cast("double"))
    return model


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = batch.column(0).to_numpy().view(np.uint64) * ODD  # odd: no two n-grams get one key
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(1)], ["key", "logp"])


def gram_parts(level: DataFrame) -> list:
    """Broadcasts of sorted keys and their log probabilities, one for each value of the
    leading bits of the key; the driver holds one part at a time."""
    keyed = materialize(level.select("gram", F.col("logp").cast("float")).mapInArrow(_hashed, "key bigint, logp float"), "keys")
    bits, parts = max(0, math.ceil(math.log2(max(keyed.count(), 1) / PART_GRAMS))), []
    for at in range(1 << bits):
        part = keyed.where(F.shiftrightunsigned("key", 64 - bits) == at) if bits else keyed
        found = part.toArrow()
        key, logp = found.column("key").to_numpy().view(np.uint64), found.column("logp").to_numpy()
        order = np.argsort(key)
        parts.append(level.sparkSession.sparkContext.broadcast((key[order], logp[order])))
    return parts


class Part:
    """Exact lookups in one part: places of the next bits of the keys, then the keys there."""

    def __init__(self, key: np.ndarray, logp: np.ndarray, at: int, bits: int):
        self.key, self.logp, self.at, self.bits = np.append(key, np.uint64(0)), logp, np.uint64(at), bits
        self.depth = max(1, len(key).bit_length())
        self.start = np.zeros((1 << self.depth) + 1, np.int32)
        np.cumsum(np.bincount(self._place(key), minlength=1 << self.depth), out=self.start[1:])

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key << np.uint64(self.bits) >> np.uint64(64 - self.depth)).astype(np.int64)

    def logp_of(self, code: np.ndarray) -> tuple[np.ndarray, int]:
        """Log probabilities, 0 for what is not in this part, and how many are in it."""
        key = code * ODD
        todo = np.flatnonzero(key >> np.uint64(64 - self.bits) == self.at) if self.bits else np.arange(len(key))
        value, found = np.zeros(len(key), np.float32), 0
        key = key[todo]
        place = self._place(key)
        at, end = self.start[place], self.start[place + 1]
        while len(todo):
            same = (self.key[at] == key) & (at < end)
            value[todo[same]] = self.logp[at[same]]
            found += int(same.sum())
            more = ~same & (at + 1 < end)
            todo, key, at, end = todo[more], key[more], at[more] + 1, end[more]
        return value, found


def hash_arrays(model: list[DataFrame]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: sorted n-grams, log probabilities, back-off weights, all on the driver."""
    arrays = []
    for level in model:
        found = level.select("gram", F.col("logp").cast("float"), F.coalesce("bow", F.lit(0.0)).cast("float").alias("bow")).toArrow().sort_by("gram")
        arrays.append((found.column("gram").to_numpy().view(np.uint64), *(found.column(c).to_numpy() for c in ("logp", "bow"))))
    return arrays


class Scorer:
    """Log probabilities of any n-grams from the sorted arrays, backing off from unseen ones."""

    def __init__(self, arrays: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.arrays = arrays
        unseen = 256 - len(arrays[0][0])  # bytes that share what the seen ones leave
        rest = 1 - np.exp(arrays[0][1].astype(np.float64)).sum()
        self.floor = np.log(max(rest, 1e-9) / max(unseen, 1))

    def _find(self, size: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.arrays[size - 1][0]
        at = code & np.uint64((1 << 8 * size) - 1)
        place = np.minimum(np.searchsorted(slots, at), max(len(slots) - 1, 0))
        return place, (slots[place] == at if len(slots) else np.zeros(len(at), bool))

    def logp(self, code: np.ndarray) -> np.ndarray:
        place, known = self._find(len(self.arrays), code)
        value = np.where(known, self.arrays[-1][1][place], np.float32(0)) if known.any() else np.zeros(len(code), np.float32)
        missing = np.flatnonzero(~known)
        if len(missing):
            rest, back = code[missing], np.zeros(len(missing), np.float32)
            value[missing] = self.floor
            todo = np.arange(len(missing))
            for size in range(len(self.arrays) - 1, 0, -1):
                place, known = self._find(size, rest[todo] >> np.uint64(8))
                back[todo] += np.where(known, self.arrays[size - 1][2][place], 0)
                place, known = self._find(size, rest[todo])
                value[missing[todo[known]]] = self.arrays[size - 1][1][place[known]]
                todo = todo[~known]
            value[missing] += back
        return value


def text_rules(text: bytes) -> tuple[int, int, int]:
    """Words, repeated lines, and words in three-word windows found twice or more."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else ()
    repeated = len(lines) - len(set(lines))
    if len(words) < 4:
        return len(words), repeated, 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    two = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:  # three numbers no longer fit 64 bits
        two = np.unique(two, return_inverse=True)[1]
    _, window, times = np.unique(two[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    often = times[window] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : len(often) + shift] |= often
    return len(words), repeated, int(inside.sum())


def _byte_flags(members: bytes) -> np.ndarray:
    flags = np.zeros(256, np.int64)
    flags[list(members)] = 1
    return flags


SYMBOLS = _byte_flags(b"#*$%&|<>")
LETTERS = 1 - _byte_flags(b" \t\n\v\f\r" + bytes(range(0x80, 0xC0)))  # starts of code points in words


def score_documents(docs: DataFrame, parts: list, order: int = ORDER, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, lang``, the counts of the rules and ``log_ppl`` (per byte, null if empty).

    ``parts`` (``gram_parts``) hold the n-grams of these documents, so none is unseen; one that
    is missing ends the job."""
    bits = (len(parts) - 1).bit_length()

    def opened(at: int) -> Part:
        held = Part(*parts[at].value, at, bits)
        if bits:
            vars(parts[at]).pop("_value", None)  # a task keeps no other part
        return held
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "log_ppl"]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if bits else opened(0)
        for batch in batches:
            chars, symbols = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            surprise = np.full(batch.num_rows, np.nan)
            counted: list[tuple[int, int, int]] = []
            for a, _, docs in text_slices(batch.column(2)):
                counted += map(text_rules, docs)
                rows, part = [a + i for i, d in enumerate(docs) if d], [d for d in docs if d]
                if not part:
                    continue
                starts = np.cumsum([len(d) for d in part]) - [len(d) for d in part]
                data = np.frombuffer(b"".join(part), np.uint8)
                chars[rows] = np.add.reduceat(LETTERS[data], starts)
                symbols[rows] = np.add.reduceat(SYMBOLS[data], starts)
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy()
            surprise[lengths > 0], found = 0, 0
            for at in range(len(parts)):
                scorer = only or opened(at)
                for a, _, docs in text_slices(batch.column(2)):
                    rows, part = [a + i for i, d in enumerate(docs) if d], [d for d in docs if d]
                    if part:
                        code, starts = grams(part, order)
                        value, known = scorer.logp_of(code)
                        surprise[rows] -= np.add.reduceat(value.astype(np.float64), starts)
                        found += known
            if found != lengths.sum():
                raise ValueError(f"{lengths.sum() - found} n-grams are not in the model")
            surprise /= np.maximum(lengths, 1)
            words, lines, repeats = zip(*counted) if counted else ((), (), ())
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0)
            numbers = [*(pa.array(x, pa.int64()) for x in (words, chars, symbols, lines, repeats)), sizes.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(surprise, from_pandas=True)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, {', '.join(f'{c} bigint' for c in names[2:8])}, log_ppl double"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(run, schema)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The counts, ``base_failed``, ``log_ppl``, ``weighed`` (what the bounds are compared
    with: the log perplexity of a text that passes the base rules), ``lower`` and ``upper``
    bound, and ``kept`` for every row.

    Bounds are FENCE quartile distances outside the quartiles of the texts that pass the base
    rules, have the row's language and its length to a power of two; where those are fewer than
    LIKE_ROWS, of all that have its language. A null text is empty and fails; a null language is
    a language of its own. A language whose documents all fail the base rules has no band, and
    needs none. Repeated rows are scored alike; no rows give no rows."""
    scored = materialize(score_documents(docs, gram_parts(kneser_ney(docs, text)[-1]), ORDER, id_col, text, lang), "scored")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    scored = scored.withColumn("_like", F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))))
    passed = scored.where(~F.col("base_failed")).select(F.col("lang").alias("_lang"), F.col("_like").alias("_length"), "log_ppl")
    many = passed.groupBy("_lang", "_length").count().where(F.col("count") >= LIKE_ROWS)
    many = many.select(F.col("_lang").alias("_of"), F.col("_length").alias("_sized"))
    alike = weighted_quantiles(passed, ["_lang", "_length"], "log_ppl", (0.25, 0.75)).withColumnRenamed("quantiles", "_near")
    alike = alike.join(many, F.col("_lang").eqNullSafe(F.col("_of")) & (F.col("_length") == F.col("_sized")), "left_semi")
    whole = weighted_quantiles(passed, ["_lang"], "log_ppl", (0.25, 0.75)).select(F.col("_lang").alias("_all"), F.col("quantiles").alias("_every"))
    joined = scored.join(whole, F.col("lang").eqNullSafe(F.col("_all")), "left")
    joined = joined.join(alike, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_like") == F.col("_length")), "left")
    low, high = (F.coalesce("_near", "_every")[k] for k in (0, 1))
    joined = joined.withColumns({"lower": low - FENCE * (high - low), "upper": high + FENCE * (high - low)})
    joined = joined.withColumn("weighed", F.when(~F.col("base_failed"), F.col("log_ppl")))
    inside = F.col("weighed").between(F.col("lower"), F.col("upper"))
    joined = joined.select(*(c for c in scored.columns if c not in ("_like", "n_bytes")), "lower", "upper", "weighed")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
