"""The class model against its definition, written out, and its edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrift.llm import brown

DOCS = "doc_id bigint, text string"
DRAW = random.Random(2)
NOUNS, VERBS = [[f"{k}{i}" for i in range(12)] for k in ("noun", "verb")]


def sentence(draw):
    return " ".join(f"{draw.choice(NOUNS)} {draw.choice(VERBS)}" for _ in range(draw.randint(3, 12)))


ROWS = [(i * 3, sentence(DRAW).title() + DRAW.choice(["", "\n", " only%d" % i, "\tonly%d twice%d" % (i, i // 2)])) for i in range(150)]
ROWS += [(1, None), (2, ""), (4, " \n\t "), (None, "noun1 nie gesehen verb2"), ROWS[3], (5, "é " * 2000), (7, "x" * 5000), (8, "中文 текст noun1")]


def tokens(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]


def is_held(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1


def literal_base(rows):
    counts = Counter(w for doc, text in rows if not is_held(doc) for w in (*tokens(text), None))
    total, kinds = sum(counts.values()), len(counts)
    found = []
    for doc, text in rows:
        words = [*tokens(text), None]
        score = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        found.append((doc, is_held(doc), len(words), sum(counts[w] > 0 for w in words), total, round(score, 6)))
    return sorted(found, key=str), counts


def frame_of(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("chunk", "n", "word", "score", "held")}).repartition(3)


@pytest.mark.parametrize("core,chunk", [(brown.CORE, brown.CHUNK_BYTES), (5, 300), (0, 1)])
def test_counts_equal_the_definition(spark, monkeypatch, core, chunk):
    monkeypatch.setattr(brown, "CORE", core)
    monkeypatch.setattr(brown, "CHUNK_BYTES", chunk)
    got = brown.class_scores(frame_of(spark, ROWS))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows), key=str) == literal_base(ROWS)[0]
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_score_equals_the_definition(spark):
    """All words are core words here, so classes can be read from the exchange."""
    learned = [(doc, text) for doc, text in ROWS if not is_held(doc)]
    counts = literal_base(ROWS)[1]
    core = sorted((w for w in counts if w is not None and len(w.encode()) <= 64), key=lambda w: (-counts[w], w.encode()))
    rows = [(doc, text) for doc, text in ROWS if all(len(w) <= 64 for w in tokens(text))]
    learned = [row for row in rows if not is_held(row[0])]
    counts = literal_base(rows)[1]
    docs = frame_of(spark, rows)
    chunks = brown.encode(docs, [w.encode() for w in core])
    pairs = brown.materialize(brown._pair_counts(chunks, len(core)), "pairs")
    classes, matrix = brown.exchange(pairs, len(core))
    kind = {w: int(classes[i]) for i, w in enumerate(core)} | {None: brown.END}
    steps, size, once = Counter(), Counter(), Counter()
    for _, text in learned:
        words = [None, *tokens(text), None]
        steps.update((kind[a], kind[b]) for a, b in zip(words, words[1:]))
    for w, n in counts.items():
        size[kind[w]] += n
        once[kind[w]] += n == 1 and w is not None
    into, out, fan = Counter(), Counter(), Counter()
    for (a, b), n in steps.items():
        into[b] += n
        out[a] += n
        fan[a] += 1
    total, width = sum(steps.values()), brown.END + 1

    def step(a, b):
        backed = (into[b] + 0.5) / (total + 0.5 * width)
        return (max(steps[a, b] - 0.5, 0) + 0.5 * fan[a] * backed) / out[a] if out[a] else backed

    def unseen(c):
        return (once[c] + 0.5) / (size[c] + 1)

    want = []
    for doc, text in rows:
        value, before = 0.0, brown.END
        for w in [*tokens(text), None]:
            if counts[w]:
                given = counts[w] / size[kind[w]] * (1 if w is None else 1 - unseen(kind[w]))
                value, here = value + math.log10(step(before, kind[w]) * given), kind[w]
            else:
                here = max(range(brown.CLASSES), key=lambda c: step(before, c) * unseen(c))
                value += math.log10(step(before, here) * unseen(here))
            before = here
        want.append((doc, round(value, 6)))
    got = [(r.doc_id, round(r.score, 6)) for r in brown.class_scores(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    nouns = Counter(kind[w] for w in NOUNS)
    assert not nouns.keys() & {kind[w] for w in VERBS}, "words of one kind share no class with those of the other"


def test_classes_lower_the_perplexity_of_unseen_texts(spark):
    rows = brown.class_scores(frame_of(spark, ROWS)).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_gain_is_the_change_of_the_likelihood():
    draw = np.random.default_rng(1)
    words, count = 90, brown.WIDTH
    pairs = Counter(map(tuple, draw.integers(0, words, (4000, 2))))
    pairs[3, 3] += 7
    classes = np.concatenate((draw.integers(0, brown.CLASSES, words - 2), [brown.END, brown.RARE]))

    def matrix_of(kinds):
        found = np.zeros((count, count))
        for (a, b), n in pairs.items():
            found[kinds[a], kinds[b]] += n
        return found

    matrix = matrix_of(classes)
    for word in (3, 8, 40):
        near = [(True, b, n) for (a, b), n in pairs.items() if a == word] + [(False, a, n) for (a, b), n in pairs.items() if b == word]
        gains = brown.exchange_gains(matrix, classes[word], *brown._vectors(word, *map(np.array, zip(*near)), classes))
        for to in (0, 17, 63, classes[word]):
            moved = classes.copy()
            moved[word] = to
            want = brown.likelihood(matrix_of(moved)) - brown.likelihood(matrix)
            assert gains[to] - gains[classes[word]] == pytest.approx(want, abs=1e-6)


def test_other_words_take_the_likeliest_class(spark):
    core = [w.encode() for w in NOUNS[:9] + VERBS[:9]]
    classes = np.array([0] * 9 + [1] * 9 + [brown.END, brown.RARE])
    chunks = brown.materialize(brown.encode(frame_of(spark, ROWS), core), "chunks")
    matrix = np.zeros((brown.WIDTH, brown.WIDTH))
    for r in brown._pair_counts(chunks, len(core)).collect():
        matrix[classes[r.first], classes[r.second]] += r.n
    contexts = brown.materialize(brown._contexts_of_others(chunks, len(core), classes), "contexts")
    names = {(r.chunk, r.place): bytes(r.word).decode() for r in contexts.collect()}
    got = {names[r.chunk, r.place]: (r.n, r.kind) for r in brown._classes_of_others(contexts, matrix).collect()}
    counts = literal_base(ROWS)[1]
    assert {w: n for w, (n, _) in got.items()} == {w: counts[w] for w in got}
    assert all(got[w][1] == 0 for w in NOUNS[9:]) and all(got[w][1] == 1 for w in VERBS[9:])


def test_rows_give_the_same_scores_however_dealt(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 20)
    frame = spark.createDataFrame(ROWS, DOCS)
    one = sorted(((r.doc_id, round(r.score, 8)) for r in brown.class_scores(frame.coalesce(1)).collect()), key=str)
    monkeypatch.setattr(brown, "CHUNK_BYTES", 500)
    monkeypatch.setattr(brown, "HELD_WORDS", 10)
    monkeypatch.setattr(brown, "HELD_PAIRS", 10)
    many = sorted(((r.doc_id, round(r.score, 8)) for r in brown.class_scores(frame.repartition(5)).collect()), key=str)
    assert one == many


def test_nothing_to_learn(spark):
    assert brown.class_scores(spark.createDataFrame([], DOCS)).collect() == []
    held = [(i, t) for i, t in ROWS if is_held(i)][:4]
    rows = brown.class_scores(spark.createDataFrame(held, DOCS)).collect()
    assert len(rows) == 4 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    empty = brown.class_scores(spark.createDataFrame([(0, None), (2, "")], DOCS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in empty] == [(1, 1, 2)] * 2


def test_pieces_cut_at_white_space():
    body = b"aa bb\tcc " * 50 + b"d" * 100
    assert b"".join(brown.pieces(body, 7)) == body
    assert [w for p in brown.pieces(body, 7) for w in p.split()] == body.split()
