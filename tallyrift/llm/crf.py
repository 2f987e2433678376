"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What a line shows (shares of character kinds, word lengths,
repetition) and what its neighbours show are its features; a transition weight ties
neighbouring labels together. Forward-backward gives each line's probability of being good,
and the document's score is their mean, weighted by the lines' lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import gives_back, text_slices, texts

SAMPLE_DOCUMENTS = 6000  # bound of the training sample, in whole documents
STEPS, RATE, RIDGE = 250, 0.05, 1e-3
ACCEPTED = 0.3
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "end": b".,;:",
    "loud": b"!?",
    "symbol": b"#*$%&<>@^~_=+\\/",
    "bar": b"|",
    "bracket": b"()[]{}\"'`",
    "other": bytes(range(128, 256)),
}
STEPS_OF_SHARE = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SPACE = b" \t\n\v\f\r"


def _flags(members: bytes) -> np.ndarray:
    flags = np.zeros(256, np.int32)
    flags[list(members)] = 1
    return flags


TABLES = [_flags(members) for members in KINDS.values()]
BLANK = _flags(SPACE)


def line_shares(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of every line (rows), bytes of every line, lines of every text. Texts have at
    least one line; an empty line has shares of zero."""
    data = np.frombuffer(b"".join(d + b"\n" for d in docs), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sizes = ends - starts
    lines = np.array([d.count(b"\n") + 1 for d in docs])
    total = lambda values: np.add.reduceat(values, starts)
    size = np.maximum(sizes, 1)
    blank = BLANK[data]
    opens = (blank == 0) & np.concatenate(([True], blank[:-1] == 1))  # the line feed before is blank
    words = total(opens.astype(np.int32))
    letters = sizes + 1 - total(blank)
    at = np.flatnonzero(opens)
    length = np.diff(np.append(at, len(data)))  # with the blanks behind, enough to compare words
    short = total(np.bincount(at[length <= 4], minlength=len(data)))
    shares = [total(t[data]) / size for t in TABLES]
    per_word = np.maximum(words, 1)
    doc = np.repeat(np.arange(len(docs)), lines)
    seen: set = set()
    again = np.zeros(len(ends))
    for i, (d, a, b) in enumerate(zip(doc.tolist(), starts.tolist(), ends.tolist())):
        key = (d, hash(data[a:b].tobytes()))
        again[i] = key in seen and b > a
        seen.add(key)
    shares += [short / per_word, np.minimum(letters / per_word / 20, 1), np.minimum(np.log1p(sizes) / 10, 1), again]
    heads = np.cumsum(lines) - lines
    by_text = np.stack([np.add.reduceat(s * sizes, heads) / np.maximum(np.add.reduceat(sizes, heads), 1) for s in shares], 1)
    variety = np.array([len(set(w)) / len(w) if (w := d.split()) else 0.0 for d in docs])
    return np.column_stack([*shares, variety[doc]]), sizes, lines, by_text


def features(shares: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Steps of a line's own shares, then the shares of the lines around it; a missing
    neighbour shows nothing."""
    doc = np.repeat(np.arange(len(lines)), lines)
    around = []
    for shift in (-1, 1):
        moved = np.roll(shares, -shift, axis=0)
        near = np.roll(doc, -shift) == doc
        near[-1 if shift == 1 else 0] = False
        around.append(moved * near[:, None])
    steps = (shares[:, :, None] > STEPS_OF_SHARE).reshape(len(shares), -1)
    return np.concatenate((np.ones((len(shares), 1)), shares, steps, *around), axis=1)


def _by_place(lines: np.ndarray) -> list[np.ndarray]:
    """Row numbers of all first lines, all second lines, ...; longest texts first."""
    order = np.argsort(-lines, kind="stable")
    heads = (np.cumsum(lines) - lines)[order]
    longest = lines[order]
    return [heads[: np.searchsorted(-longest, -place, "left")] + place for place in range(int(longest[0]))] if len(lines) else []


def forward_backward(emission: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every line, expected transitions (summed), log partition of every text
    in the order of ``_by_place``. ``emission`` has the log potentials bad, good."""
    places = _by_place(lines)
    ahead, behind = np.empty_like(emission), np.zeros_like(emission)
    for t, rows in enumerate(places):
        ahead[rows] = emission[rows]
        if t:
            before = ahead[places[t - 1][: len(rows)]]
            ahead[rows] += np.logaddexp(before[:, :1] + transition[0], before[:, 1:] + transition[1])
    for t in range(len(places) - 2, -1, -1):
        after = places[t + 1]
        rows = places[t][: len(after)]
        ahead_of = emission[after] + behind[after]
        behind[rows] = np.logaddexp(transition[:, 0] + ahead_of[:, :1], transition[:, 1] + ahead_of[:, 1:])
    both = ahead + behind
    log_z = np.logaddexp(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    for t in range(1, len(places)):
        rows, before = places[t], places[t - 1][: len(places[t])]
        joint = ahead[before][:, :, None] + transition + (emission[rows] + behind[rows])[:, None, :]
        pairs += np.exp(joint - log_z[rows][:, None, None]).sum(0)
    return np.exp(both - log_z[:, None]), pairs, log_z


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of good against bad
    transition: np.ndarray

    def good(self, shares: np.ndarray, lines: np.ndarray) -> np.ndarray:
        x = (features(shares, lines) - self.mean) / self.scale
        emission = np.stack((np.zeros(len(x)), x @ self.weights), 1)
        return forward_backward(emission, self.transition, lines)[0][:, 1]


def train(shares: np.ndarray, lines: np.ndarray, label: np.ndarray) -> Model:
    """Maximum conditional likelihood with every line labelled like its text, by gradient
    steps with adaptive moments; a text's gradient is divided by its lines."""
    x = features(shares, lines)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[0], scale[0] = 0, 1
    x = (x - mean) / scale
    line_label = np.repeat(label, lines)
    share = np.repeat(1.0 / lines, lines)
    inner = np.repeat(lines > 1, lines)
    weights, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    wanted = np.zeros((2, 2))
    for k in (0, 1):
        wanted[k, k] = (lines[label == k] - 1).sum()
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        emission = np.stack((np.zeros(len(x)), x @ weights), 1)
        marginal, pairs, _ = forward_backward(emission, transition, lines)
        slope = x.T @ ((marginal[:, 1] - line_label) * share) / len(lines) + RIDGE * weights
        turn = (pairs - wanted) / max(inner.sum(), 1) + RIDGE * transition
        for k, (value, gradient) in enumerate(((weights, slope), (transition, turn))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (gradient - m)
            v += 0.001 * (gradient * gradient - v)
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights, transition)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, label = texts(batch.column(0)), batch.column(1)
        for row, doc in enumerate(docs):
            shares, _, lines = line_shares([doc])[:3]
            yield pa.RecordBatch.from_arrays([pa.array([shares.ravel().tolist()]), label.slice(row, 1)], ["shares", "label"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Train on at most SAMPLE_DOCUMENTS labelled documents outside the held-out fold, those
    with the smallest hashes, and all of their lines. None if a class is absent."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCUMENTS)
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("_id"))  # at most SAMPLE_DOCUMENTS pairs
    found = rows.select(F.col(text), "_label").limit(2 * SAMPLE_DOCUMENTS).mapInArrow(_sampled, "shares array<double>, label int").toArrow()
    label_of = found.column("label").to_numpy()
    if len(set(label_of.tolist())) < 2:
        return None
    parts = [np.array(s) for s in found.column("shares").to_pylist()]
    width = line_shares([b""])[0].shape[1]
    parts = [p.reshape(-1, width) for p in parts]
    lines = np.array([len(p) for p in parts])
    order = np.lexsort(([float(p.sum()) for p in parts], label_of, lines))  # rows arrive in no fixed order
    return train(np.concatenate([parts[i] for i in order]), lines[order], label_of[order].astype(float))


def score_quality(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns (default the id) plus the score and the prediction of every row. A
    null text is one empty line, scored like any line. Without a model every score is 0.5."""
    keep = keep or [id_col]
    at = keep.index(text) if text in keep else len(keep)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            for a, b, docs in text_slices(batch.column(at)) if model else ():
                shares, sizes, lines, _ = line_shares(docs)
                weight = sizes + 1.0
                heads = np.cumsum(lines) - lines
                good = model.good(shares, lines)
                score[a:b] = np.add.reduceat(good * weight, heads) / np.add.reduceat(weight, heads)
            score = np.clip(score, 0, 1)
            columns = [*batch.columns[: len(keep)], pa.array(score), pa.array((score >= ACCEPTED).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    columns = [f"`{c}`" for c in (*keep, text)[: len(keep) + (at == len(keep))]]
    return docs.select(columns).mapInArrow(run, f"{kinds}, `{names[0]}` double, `{names[1]}` int")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``. A null id is in no fold and not held out.
    Repeated rows are scored alike; no rows give no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    scored = score_quality(rows, fit(docs, labels, id_col, text))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
