"""Spelling variants by neighbourhoods over a reduced alphabet.

Letters are replaced by a few symbols, so that words become reduced words over a small
alphabet. Every reduced word generates its neighbourhood of one edit, which is short because
symbols are few; what meets the reduced vocabulary is a candidate and is verified on the
original words. Two words one edit apart have reduced words one edit apart or equal, so none
is lost. An insertion is met as the deletion of the longer word, and of two substitutions
that lead to each other one is generated: each pair meets once.

The number of symbols follows from the vocabulary: the least of SYMBOLS for which words
share their reduced word with about one other, also where many words are alike."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import gives_back, text_slices
from tallyrift.session import materialize

LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))  # after lower-casing A-Z
LEAST_LENGTH = 7
LEAST_COUNT = 2
DAMAGED = 31  # one run in so many loses a letter
FORM_TIMES = 10
SYMBOLS = (4, 6, 8, 12, 18, 27, 40, 60, len(LETTERS))
HELD_WORDS = 1 << 18
CELLS = 1 << 21
FILTER_BITS = 1 << 27  # at most 16 MB
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
WORD = "word string, n bigint"


def _plain_letters() -> bytes:
    """A table over Latin-1 bytes: letters as lower case (only A-Z change), all else a space."""
    return bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 0xC0 else 32 for b in range(256))


def damaged_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of all runs of letters in ``docs`` after some lost a letter; words of
    LEAST_LENGTH letters at least, in partial counts. A null text has no words, a null id is
    written as nothing; repeated rows count again."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            names = [w.decode("latin-1") for w in counts]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        plain, counts = _plain_letters(), Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, _, bodies in text_slices(batch.column(1)):
                for doc, body in enumerate(bodies, at):
                    letters = body if body.isascii() else body.decode().encode("latin-1", "replace")
                    words = Counter(w for w in letters.translate(plain).split() if len(w) >= LEAST_LENGTH)
                    prefix = zlib.crc32(f"{'' if ids[doc] is None else ids[doc]}:".encode())
                    for word, n in words.items():
                        code = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if code % DAMAGED == 0:
                            gone = code % len(word)
                            word = word[:gone] + word[gone + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        counts[word] += n
                    if len(counts) > HELD_WORDS:
                        yield counted()
                        counts = Counter()
        if counts:
            yield counted()

    return docs.select("doc_id", "text").mapInArrow(run, WORD)


def reduced_alphabet(words: DataFrame) -> str:
    """A symbol for each of LETTERS. Letters are dealt by their frequency, the most frequent
    first, to the symbol with the least so far."""
    seen = {r.letter: r.n for r in words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = words.count()
    for size in SYMBOLS:
        load, given = [0] * size, {}
        for letter in sorted(LETTERS, key=lambda c: (-seen.get(c, 0), c)):
            symbol = min(range(size), key=lambda s: (load[s], s))
            load[symbol] += seen.get(letter, 0) + 1
            given[letter] = LETTERS[symbol]
        alphabet = "".join(given[c] for c in LETTERS)
        sharing = words.groupBy(F.translate("word", LETTERS, alphabet)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        if (sharing or 0) <= 2 * total:
            break
    return alphabet


class Reduced:
    """Reduced words as 64-bit keys: the sum of symbol times BASE to the place, so that an
    edit changes one term. Equal keys of different words only cost a verification."""

    def __init__(self, alphabet: str):
        self.symbols = sorted(set(alphabet))
        self.code = np.zeros(256, np.uint64)
        for letter, symbol in zip(LETTERS, alphabet):
            self.code[ord(letter)] = self.symbols.index(symbol) + 1
        self.back = np.uint64(pow(BASE, -1, 1 << 64))

    def blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``rows, symbols, prefix sums`` of words of one length each, CELLS neighbours at a time."""
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            step = max(1, CELLS // (int(length) * (len(self.symbols) + 1)))
            power = np.empty(length, np.uint64)
            power[:] = BASE
            power = np.multiply.accumulate(power)
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                body = "".join(words[r] for r in part).encode("latin-1")
                codes = self.code[np.frombuffer(body, np.uint8).reshape(len(part), length)]
                sums = np.zeros((len(part), length + 1), np.uint64)
                np.cumsum(codes * power, axis=1, out=sums[:, 1:])
                yield part, codes, sums

    def keys(self, words: list[str]) -> np.ndarray:
        found = np.zeros(len(words), np.uint64)
        for rows, _, sums in self.blocks(words):
            found[rows] = sums[:, -1]
        return found

    def neighbours(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``rows, keys`` of each word's own key (marked), its substitutions with a smaller key
        and its deletions."""
        for rows, codes, sums in self.blocks(words):
            own, length = sums[:, -1], codes.shape[1]
            yield rows, own, True
            power = np.empty(length, np.uint64)
            power[:] = BASE
            power = np.multiply.accumulate(power)
            for symbol in range(1, len(self.symbols) + 1):
                changed = own[:, None] + (np.uint64(symbol) - codes) * power
                at, _ = np.nonzero(changed < own[:, None])
                yield rows[at], changed[changed < own[:, None]], False
            gone = sums[:, :-1] + (own[:, None] - sums[:, 1:]) * self.back
            first = np.ones(codes.shape, bool)  # in a run of one symbol all deletions are the same
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            at, _ = np.nonzero(first)
            yield rows[at], gone[first], False


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys * np.uint64(MIX) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every pair of ``words`` (``word, n``, distinct, stored)
    one inserted, deleted or replaced letter apart, once.

    Neighbours first meet a bit set of the reduced vocabulary (at most FILTER_BITS, whatever
    the vocabulary), so that few that exist nowhere are sent to the join."""
    alphabet = reduced_alphabet(words)
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * max(words.count(), 1)).bit_length()))

    @gives_back
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(alphabet)
        for batch in batches:
            keys = reduced.keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.view(np.int64)), pa.array(_slots(keys, bits) + 1)], ["word", "n", "key", "slot"])

    vocabulary = materialize(words.select("word", "n").mapInArrow(keyed, f"{WORD}, key bigint, slot bigint"), "reduced")
    held = vocabulary.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    seen = np.zeros(bits // 8, np.uint8)
    for row in held.collect():  # FILTER_BITS at most
        start = (row.bucket - 1) * (1 << 12)
        seen[start : start + len(row.bits)] = np.frombuffer(row.bits, np.uint8)[: len(seen) - start]

    @gives_back
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(alphabet)
        for batch in batches:
            for rows, keys, same in reduced.neighbours(batch.column(0).to_pylist()):
                slots = _slots(keys, bits)
                known = (seen[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
                picked = pa.array(rows[known])
                own = pa.array(np.full(len(picked), same))
                yield pa.RecordBatch.from_arrays([*(c.take(picked) for c in batch.columns), pa.array(keys[known].view(np.int64)), own], ["word", "n", "key", "same"])

    near = words.select("word", "n").mapInArrow(around, f"{WORD}, key bigint, same boolean").alias("l")
    meets = (F.col("l.key") == F.col("r.key")) & (F.levenshtein(F.col("l.word"), F.col("r.word"), 1) == 1)
    once = ~F.col("l.same") | (F.col("l.word") < F.col("r.word"))  # words of one key would meet twice
    return near.join(vocabulary.alias("r"), meets & once).select(
        "l.word", "l.n", F.col("r.word").alias("other"), F.col("r.n").alias("other_n")
    )


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root``: forms followed to the last. A form is FORM_TIMES as frequent as its
    word, so that ``most`` bounds the steps; each join doubles the steps made."""
    steps, reach = 0, LEAST_COUNT
    while reach * FORM_TIMES <= most:
        steps, reach = steps + 1, reach * FORM_TIMES
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = roots.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        roots = roots.join(onward, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_on", "root").alias("root"))
    return roots


def spelling_variants(words: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word (``word, n``, distinct, stored).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (of equals
    the least in code-point order) if FORM_TIMES as frequent, ``root`` the last of forms. No
    words give no rows."""
    pairs = near_pairs(words)
    one = F.struct(F.col("word"), F.col("other"), F.col("other_n"))
    two = F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    ends = pairs.select(F.inline(F.array(one, two)))
    near = ends.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    frequent = -F.col("best.less") >= FORM_TIMES * F.col("n")
    found = materialize(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    most = found.agg(F.max("n")).first()[0] or 0
    roots = _roots(found.where("form is not null").select("word", "form"), most)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame) -> DataFrame:
    """Spelling variants among the damaged words of ``docs`` that occur LEAST_COUNT times."""
    counted = damaged_words(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return spelling_variants(materialize(counted, "words"))
