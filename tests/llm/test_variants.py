"""Spelling variants against all pairs of words, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyrift.llm import variants

DOCS = "doc_id bigint, text string"


def literal_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def literal_variants(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return rows


def result(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def edited(draw, word, letters):
    at = draw.randrange(len(word))
    return draw.choice([word[:at] + word[at + 1 :], word[:at] + draw.choice(letters) + word[at:], word[:at] + draw.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("letters", ["abcdeéÿ×", "ab", "abcdefghijklmnopqrstuvwxyz"])
def test_variants_equal_all_pairs(spark, letters):
    draw = random.Random(len(letters))
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(6, 12))) for _ in range(60)]
    words = stems + [edited(draw, draw.choice(stems), letters) for _ in range(300)]
    rows = []
    for doc in range(300):
        picked = [draw.choice(stems[:6]) for _ in range(30)] + [draw.choice(words) for _ in range(12)]
        rows.append((doc, draw.choice([" ", "-", "\n", "1", "中"]).join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in picked)))
    rows += [rows[3], rows[3], (None, rows[4][1]), (7, None), (8, ""), (9, "İstanbul İSTANBUL abcdefgĀhijklmno"), (10, "x" * 30_000 + " " + "x" * 30_000)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "key", "slot")}).repartition(3)
    assert result(variants.corpus_variants(frame)) == literal_variants(literal_words(rows))


def test_chains_of_forms(spark):
    words = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "abcdefghijz": 20000, "zzzzzzzz": 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = result(variants.spelling_variants(frame))
    assert got == literal_variants(words)
    assert got["abcdefg"][1] == "abcdefghijk"


def test_words_that_share_their_reduced_word(spark):
    draw = random.Random(4)
    words = {"".join(draw.choice("ae") for _ in range(9)): draw.randint(2, 500) for _ in range(200)}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert result(variants.spelling_variants(frame)) == literal_variants(words)


def test_filter_that_is_full(spark, monkeypatch):
    monkeypatch.setattr(variants, "FILTER_BITS", 1 << 15)
    draw = random.Random(6)
    words = {"".join(draw.choice("abcdefgh") for _ in range(8)): draw.randint(2, 500) for _ in range(1500)}
    words |= {edited(draw, w, "abcdefgh"): 3 for w in list(words)[:300]}
    words = {w: n for w, n in words.items() if len(w) >= 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert result(variants.spelling_variants(frame)) == literal_variants(words)


def test_no_words(spark):
    assert variants.corpus_variants(spark.createDataFrame([], DOCS)).collect() == []
    assert variants.corpus_variants(spark.createDataFrame([(1, None), (2, "short words")], DOCS)).collect() == []
