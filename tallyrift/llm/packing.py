"""Best-fit packing with several capacities.

A piece of a document needs tokens, one document slot and attention cost (its length
squared). A bin accepts it only if all three residual capacities allow; among those bins
the one whose weighted residual would be smallest (``norm``) or whose residual points most
along the demand (``dot``) is taken."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyrift.llm.common import gives_back, share, text_slices
from tallyrift.session import materialize

TOKENS = 4096
SHARD_ROWS = 4096
CACHED_WORDS = 1_000_000


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others
    as the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Ids of a text as little-endian 32-bit bytes, word by word.

    The vocabulary drops white space and never joins tokens across it, so a text's ids are
    those of its words in turn; each worker keeps the ids of words it has met. A word of
    Latin letters and signs is cut by the vocabulary's own pattern and merged by its model
    (the tokenizer's own bookkeeping takes most of its time); other words go through the tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        kinds = [s["type"] for s in steps["normalizer"]["normalizers"]], [s["type"] for s in steps["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("this vocabulary is not cut at white space")
        self.pieces = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ")
        self.latin = re.compile("[!-~\u00a1-\u024f]+")  # composed letters, no white space
        self.letters = _byte_letters()
        self.merge = self.tokenizer.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.bytes_of[t.id] for t in self.merge(written)])
            self.parts[part] = ids
        return ids

    def _learn(self, words: set[str]) -> None:
        """Note the ids of new words. All Latin words are cut in one go, with the spaces
        between them, and all others are one batch of the tokenizer."""
        latin, others = [], []
        for word in words:
            (latin if "<|" not in word and self.latin.fullmatch(word) else others).append(word)
        known, parts, at, ids = self.known, self.parts, 0, []
        for part in self.pieces.findall(" ".join(latin).lower()):
            if part == " ":
                known[latin[at]] = b"".join(ids)
                at, ids = at + 1, []
            else:
                ids.append(parts.get(part) or self._part(part))
        if latin:
            known[latin[at]] = b"".join(ids)
        if others:
            for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
                known[word] = np.array(found.ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.parts) > CACHED_WORDS:
                self.parts = {}
            if len(self.known) > CACHED_WORDS:
                self.known, new = {"": b""}, set().union(*split).difference(("",))
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end: int = 1, most: int = TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, cut into
    pieces of ``most`` tokens; ``end`` is added to each. A null text is empty, which leaves
    the end token alone; whole texts are read. Repeated rows give repeated pieces."""
    closing = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens(path)
        for batch in batches:
            ids = batch.column(0)
            for at, _, body in text_slices(batch.column(1)):
                found: list[tuple] = []
                for row, data in enumerate(encoder.encode_all([t.decode() for t in body]), at):
                    data += closing
                    for piece, start in enumerate(range(0, len(data), 4 * most)):
                        cut = data[start : start + 4 * most]
                        found.append((row, piece, start // 4, len(cut) // 4, zlib.crc32(cut), cut))
                row, *columns, cuts = zip(*found)
                arrays = [ids.take(pa.array(row)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in cuts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(demands: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each demand (rows), bins numbered from 0 as they open. Largest first by
    weighted share of the capacity; ties keep the given order. A demand that alone exceeds
    a capacity gets a bin of its own."""
    scaled = weights / capacity
    order = np.argsort(-(demands * scaled).sum(1), kind="stable")
    bins, left, name = np.full(len(demands), -1), np.empty((64, demands.shape[1])), np.empty(64, np.int64)
    count = opened = 0
    least = demands.min(0) if len(demands) else capacity
    for item in order:
        need = demands[item]
        free = left[:count]
        fits = np.flatnonzero((free >= need).all(1))
        if len(fits):
            after = (free[fits] - need) * scaled
            value = (after * after).sum(1) if rule == "norm" else -(free[fits] * scaled) @ (need * scaled)
            at = fits[np.argmin(value)]
            left[at] -= need
        else:
            if count == len(left):
                left, name = np.concatenate((left, left)), np.concatenate((name, name))
            at, count = count, count + 1
            left[at], name[at] = capacity - need, opened
            opened += 1
        bins[item] = name[at]
        if (left[at] < least).any():  # nothing fits any more
            count -= 1
            left[at], name[at] = left[count], name[count]
    return bins


def pack(pieces: DataFrame, tokens: int = TOKENS, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", seed: int = 11) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``, its gapless place there.

    Pieces are dealt by a seeded hash into shards of about SHARD_ROWS, each packed by one
    task, so a shard wastes at most a part of its last bins. Without ``documents`` and
    ``attention`` these capacities cannot bind (``tokens`` pieces of one token, ``tokens``
    squared). ``pieces`` is a stored table with ``length``; repeated rows are packed apart."""
    capacity = np.array([tokens, documents or tokens, attention or float(tokens) ** 2], float)
    shards = share(pieces.count(), SHARD_ROWS, 1 << 31)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [c for c in ("doc_id", "piece") if c in rows]
        rows = rows.sort_values(["length", *keys], ascending=[False] + [True] * len(keys), kind="stable").reset_index(drop=True)
        length = rows["length"].to_numpy(float)
        demands = np.stack([length, np.ones(len(rows)), length * length], 1)
        bins = best_fit(demands, capacity, np.array(weights), rule)
        rows["sequence_id"] = rows.pop("_shard").to_numpy() * (1 << 24) + bins
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows

    shard = F.pmod(F.xxhash64(F.lit(seed), *pieces.columns), F.lit(shards))
    schema = f"{pieces.schema.toDDL()}, sequence_id bigint, offset bigint"
    return pieces.withColumn("_shard", shard).groupBy("_shard").applyInPandas(run, schema)


def packed(docs: DataFrame, path: str, **limits) -> DataFrame:
    """Tokenize, cut and pack ``docs``; no documents give no rows."""
    return pack(materialize(token_pieces(docs, path), "pieces"), **limits)
