"""The operators against brute force, round trips and held-out accuracy, and their edge cases."""

import bisect
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tallyrift.llm import chat, common, crf, graph, mixing, packing, perplexity, repeats, simhash, warc, winnow, wrappers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["code", "key", "root", "version", "kept", "spans", "score", "predicted", "repeats", "_size", "_hash", "_at", "component_id"]
DRAW = random.Random(5)
WORDS = ["".join(DRAW.choice("abcdeé") for _ in range(DRAW.randint(1, 9))) for _ in range(400)]


def prose(count, draw=DRAW):
    return " ".join(draw.choice(WORDS) for _ in range(count))


LONG = prose(3000)
TEXTS = [None, "", " \n\t ", "one", "two words", LONG, LONG + " tail", "x" * 5000, prose(80), prose(40) + "\n" + prose(60)] + [prose(60) for _ in range(6)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i * 7 - 20, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[8], (None, prose(70), "en", "s1", 3), (rows[9][0], prose(50), "de", "s2", 4)]  # repeated row, null id, repeated id
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


# ---- SimHash


def literal_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def literal_components(codes):
    """Smallest position reachable over links of three bits at most."""
    codes = np.array(codes, np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    root = np.arange(len(codes))
    while True:
        low = np.where(near, root[None, :], len(codes)).min(1)
        if (low == root).all():
            return root
        root = low


def test_fingerprints_and_groups(documents):
    got = simhash.simhash_groups(documents).toPandas()
    source = documents.select("doc_id", "text").toPandas()
    codes = {(r.doc_id if r.doc_id == r.doc_id else None): [] for r in source.itertuples()}
    for r in source.itertuples():
        codes[r.doc_id if r.doc_id == r.doc_id else None].append(f"{literal_fingerprint(r.text):016x}")
    for r in got.itertuples():
        assert r.fingerprint in codes[r.doc_id if r.doc_id == r.doc_id else None]
    assert len(got) == len(source)
    by_code = got.groupby("fingerprint").doc_id.min().sort_values(na_position="last")
    roots = literal_components([int(c, 16) for c in by_code.index])
    smallest = dict(zip(by_code.index, by_code.to_numpy()[roots]))
    for r in got.itertuples():
        assert r.component_id == smallest[r.fingerprint] or (r.component_id != r.component_id and smallest[r.fingerprint] != smallest[r.fingerprint])


def dense_codes(count=700, seed=3):
    draw = np.random.default_rng(seed)
    codes = set(draw.integers(0, 2**63, 200, dtype=np.int64).tolist())
    for centre in list(codes)[:12]:
        for _ in range(count // 12):
            code = centre
            for bit in draw.integers(0, 63, draw.integers(0, 5)):
                code ^= 1 << int(bit)
            codes.add(code)
    return sorted(codes)


@pytest.mark.parametrize("limit", [4096, 16])
def test_index_finds_every_link(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    codes = dense_codes()
    frame = spark.createDataFrame([(c,) for c in codes], "code bigint")
    root = {r.code: r.root for r in simhash.near_groups(frame).collect()}
    wanted = literal_components(codes)
    assert [root.get(c, c) for c in codes] == [codes[i] for i in wanted]


def test_links_of_one_dense_group():
    codes = np.array(dense_codes(2000), np.int64).view(np.uint64)
    member, root = simhash.link_groups(codes, np.zeros(len(codes), np.int64))
    found = np.arange(len(codes))
    found[member] = root
    wanted = literal_components(codes)
    assert len(set(zip(found.tolist(), wanted.tolist()))) == len(set(wanted.tolist())) == len(set(found.tolist()))


def test_gray_rank_counts_up():
    codes = np.arange(64, dtype=np.uint64)
    assert simhash.gray_rank(codes ^ codes >> np.uint64(1)).tolist() == list(range(64))


def test_near_copies_keep_one_row(documents, nothing):
    kept = simhash.drop_near_copies(documents)
    assert kept.columns == documents.columns
    groups = simhash.simhash_groups(documents)
    assert kept.count() == groups.select("component_id").distinct().count()
    assert simhash.drop_near_copies(nothing).count() == 0 and simhash.simhash_groups(nothing).count() == 0
    without_ids = documents.withColumn("doc_id", F.lit(None).cast("bigint"))
    codes = sorted({literal_fingerprint(r.text) for r in documents.select("text").collect()})
    assert simhash.drop_near_copies(without_ids).count() == len(set(literal_components(codes).tolist()))


def five_words(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def test_stage_drops_copies_of_similarity_08_only(spark):
    draw = random.Random(11)
    rows = []
    for i in range(40):
        words = prose(200, draw).split()
        changed = list(words)
        for at in draw.sample(range(0, 200, 10), 1 + i % 8):
            changed[at] = f"new{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    sets = [five_words(t) for _, t in rows]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 80, 2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert all(2 * i in kept for i in range(40))
    assert all(2 * i + 1 in kept for i, j in enumerate(alike) if j < 0.8)
    near = [2 * i + 1 not in kept for i, j in enumerate(alike) if j >= 0.8]
    assert len(near) > 10 and sum(near) >= 0.9 * len(near)


def test_every_group_of_a_repeated_id_keeps_a_row(spark):
    first, second, third = (prose(60) for _ in range(3))
    rows = [(1, first, "en", "s", 1), (1, second, "de", "s", 2), (2, first, "en", "s", 3), (3, second, "en", "s", 4), (4, third, "en", "s", 5), (1, first, "en", "s", 1)]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, first), (1, second), (4, third)])


@pytest.mark.parametrize("limit", [4096, 16])
def test_neighbour_keys_find_every_link_of_14_bits(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_ROWS", limit)
    draw = np.random.default_rng(8)
    codes = draw.integers(0, 2**63, 40, dtype=np.int64).tolist()
    codes += [c ^ sum(1 << int(b) for b in draw.choice(63, 14, replace=False)) for c in codes]
    frame = spark.createDataFrame([(c,) for c in codes], "code bigint")
    root = {r.code: r.root for r in simhash.near_groups(frame, 14).collect()}
    assert all(root.get(a, a) == root.get(b, b) for a, b in zip(codes, codes[40:]))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (100, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# ---- Web pages

PAGE = """<html><body class="{0}"><header>Site</header><nav><a href=/>Home</a></nav><div id="ads">Buy {1}</div>
<div class="story"><h1>T {1}</h1><p>First &amp; {1}<br>line <b>bold</b></p><p>Second&nbsp;{1}<div class="share-tools">Share</div></div>
<aside>Side {1}</aside><form><p>Ask</p></form><div class="comments"><p>Reader says {1} and more and more text here</p></div>
<script>var a = "<p>no</p>";</script><style>p{{}}</style><footer>End</footer></body></html>"""


def test_main_text_of_unmarked_pages(spark):
    rows = [(i, f"http://A.example/{i}", PAGE.format("x", f"word{i} " * (i + 1))) for i in range(6)]
    rows += [(10, None, None), (11, "http://a.example/x", ""), (12, "::bad[", "plain <b>text</b>"), (0, rows[0][1], rows[0][2])]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in wrappers.extract_main_text(frame).collect()}
    for i in range(6):
        words = " ".join([f"word{i}"] * (i + 1))
        assert got[i].text == f"T {words}\nFirst & {words} line bold\nSecond {words}"
        assert got[i].n_chars == len(got[i].text)
    assert (got[10].text, got[11].text, got[12].text) == ("", "", "plain text")
    assert wrappers.extract_main_text(frame).count() == len(rows)
    assert wrappers.extract_main_text(frame.limit(0)).count() == 0


def test_join_route_gives_the_same_texts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format("x", f"w{i}")) for i in range(8)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sent = rows_of(wrappers.extract_main_text(frame), "page_id", "text")
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert rows_of(wrappers.extract_main_text(frame), "page_id", "text") == sent


def test_wrapper_has_groups_optionals_and_slots():
    pages = [
        "<article><h2>A</h2><p>1</p><h2>B</h2><p>2</p><h2>C</h2><p>3</p><div>same</div></article>",
        "<article><h2>A</h2><p>9</p><div>same</div><ul><li>x<li>y</ul></article>",
    ]
    both = [wrappers.page_wrapper(wrappers.parse(p)) for p in pages]
    merged = wrappers.merge(*both)[wrappers.CHILDREN][0][wrappers.CHILDREN]
    assert [wrappers._label(c) for c in merged] == ["(h2 p)", "div", "ul"]
    assert merged[0][wrappers.REPEATED] and merged[2][wrappers.PAGES] == 1
    assert merged[1][wrappers.CONSTANT] > 0 and merged[0][wrappers.CHILDREN][1][wrappers.CONSTANT] == -1
    assert all(wrappers.load(wrappers.dump(child)) == child for child in merged)


def test_tags_may_be_nested_to_any_depth(spark):
    """Wrappers of deep pages merge, travel and name the article like those of flat pages."""
    deep = 5000

    def page(i):
        return "<div>" * deep + "<section>" * deep + f"<p>story {i} of {i * 7}</p>" + "</section>" * deep + "</div>" * deep

    marked = "<main>" + "<div>" * deep + "<p>marked</p><aside>gone</aside>" + "</div>" * deep + "</main><p>outside</p>"
    rows = [(i, "http://deep.example/", page(i)) for i in range(3)] + [(9, "http://m.example/", marked)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract_main_text(frame).collect()}
    assert got == {**{i: f"story {i} of {i * 7}" for i in range(3)}, 9: "marked"}


def test_open_quotes_and_comments_end():
    page = "<article><p title=\"a>b\">one</p><p class='x>two</p><!-- <p>no --><p>three</p><script>never closed <p>no"
    blocks = wrappers.parse(page)
    text = wrappers.main_text(blocks, wrappers.article_paths(wrappers.page_wrapper(blocks)))
    assert text.startswith("one") and text.endswith("three") and "no" not in text


# ---- Winnowing


def literal_winnow(text):
    pieces = re.findall(r"[^\x20\x09-\x0D]{1,4}", text or "")
    sign = lambda s: xxhash.xxh64_intdigest(s.encode(), 42) & winnow.PRIME
    if not pieces:
        return []
    if len(pieces) < winnow.GRAM:
        return [(sign(" ".join(pieces)) % winnow.PRIME, 0)]
    single = [sign(p) % winnow.PRIME for p in pieces]
    grams = []
    for i in range(len(single) - winnow.GRAM + 1):
        value = 0
        for x in single[i : i + winnow.GRAM]:
            value = (value * winnow.BASE + x) % winnow.PRIME
        grams.append(value)
    chosen = []
    for i in range(max(1, len(grams) - winnow.WINDOW + 1)):
        window = grams[i : i + winnow.WINDOW]
        low = min(window)
        at = i + max(k for k, v in enumerate(window) if v == low)
        if (low, at) not in chosen:
            chosen.append((low, at))
    return chosen


def test_winnowing_against_the_definition(documents, nothing):
    source = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    order = sorted(source, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text))
    got = winnow.edited_fingerprints(documents).collect()
    assert len(got) == len(order)
    write = lambda f: " ".join(f"{h:x}:{p}" for h, p in f)
    known = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)
    wanted = []
    for i, r in enumerate(order):
        after = order[(i + 1) % len(order)].text
        third = len(r.text) // 3
        edited = r.text[: len(r.text) - third] + after[:third]
        a, b, c = (literal_winnow(t) for t in (r.text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        sets = [{h for h, _ in f} for f in (a, b, c)]
        wanted.append((r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest(), write(a), write(b), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    assert known == sorted(wanted, key=str)
    assert winnow.edited_fingerprints(nothing).count() == 0
    assert "Python" not in (plan := winnow.edited_fingerprints(documents)._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 3)
    ids = DRAW.sample(range(-500, 500), 40) + [2**62, -(2**63), 2**63 - 1]
    frame = spark.createDataFrame([(i, f"{i} text " * 9) for i in ids], "doc_id bigint, text string")
    order = sorted(ids, reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in winnow.edited_fingerprints(frame).collect()}
    for at, i in enumerate(order):
        text, after = f"{i} text " * 9, f"{order[(at + 1) % len(order)]} text " * 9
        third = len(text) // 3
        assert got[i] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()


def test_id_ranges_hold_equally_many_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BUCKET_ROWS", 50)
    ids = [*range(5000), 2**61, -(2**62), None, *[77] * 300]
    frame = spark.createDataFrame([(i, "x") for i in ids], "doc_id bigint, text string")
    known = sorted(i for i in ids if i is not None)
    bounds = winnow.id_bounds(frame.select(F.col("doc_id").alias("_id")))
    assert bounds[0] == known[0] and len(bounds) <= len(known) / 50 + spark.sparkContext.defaultParallelism + 4
    for some in (bounds, bounds[:1], bounds[:2], bounds[:7], []):
        got = frame.select("doc_id", winnow.range_of(F.col("doc_id"), some).alias("at")).collect()
        assert all(r.at == (-1 if r.doc_id is None else max(bisect.bisect_right(some, r.doc_id) - 1, 0)) for r in got)
    sizes = winnow.with_next(frame, "doc_id", "text").where("_ghost = 0").groupBy("_at").count().collect()
    assert max(r["count"] for r in sizes) <= 350 and sorted(r["count"] for r in sizes)[-2] <= 51


# ---- Mixing


def test_single_sources_come_near_their_targets(spark):
    draw = random.Random(8)
    rows = [(i, draw.choice(["a", "b", "B", "é", None]), draw.randint(0, 300) if i % 9 else None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumns({c: F.lit(1) for c in CLASHING})
    sources = mixing.weighted_sources(frame.withColumn("size", F.coalesce("size", F.lit(0))), "size")
    known = {r.source: r for r in sources.collect()}
    assert [known[s].weight for s in ("B", "a", "b", "é", None)] == [1, 2, 3, 1, 2]
    total = sum(r.source_size for r in known.values())
    assert sum(r.target for r in known.values()) == pytest.approx(total)
    quotas = sources.select("source", F.col("target").alias("quota"))
    runs = [rows_of(mixing.mix(frame.repartition(n), F.array("source"), F.col("size"), quotas, name="times"), "doc_id", "source", "size", "times") for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    taken = defaultdict(int)
    for _, source, size, times in runs[0]:
        assert 0 <= times <= 3
        taken[source] += times * (size or 0)
    for source, row in known.items():
        assert abs(taken[source] - row.target) <= max(5, 0.01 * row.target)


def test_capped_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 30, 3)], "source string, source_size bigint, weight bigint")
    got = {r.source: r.target for r in mixing.capped_targets(sizes, 1040).collect()}
    assert got == {"a": 30.0, "b": 920.0, "c": 90.0}
    assert mixing.capped_targets(sizes.limit(0), 0).count() == 0


def test_mix_without_any_word_ends(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \n ", "en", None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    sizes = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "source string, source_size bigint, weight bigint")
    calls, agg = [], type(sizes).agg

    def counted(self, *columns):
        calls.append(1)
        assert len(calls) < 10, "the level is searched for ever"
        return agg(self, *columns)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(sizes), "agg", counted)
        assert [r.target for r in mixing.capped_targets(sizes, 0).collect()] == [0, 0]
        assert corpus_pipeline.mixture(spark, docs, "").count() == 0


def test_flow_fills_quotas_at_least_cost():
    supply = {("a",): 10, ("a", "b"): 20, ("b", "c"): 30, ("d",): 5}
    sent = mixing.min_cost_flow(supply, {"a": 25, "b": 40, "c": 10, "d": 100}, [0.0, 1.0, 4.0])
    assert sum(v for (_, s), v in sent.items() if s == "a") == pytest.approx(25)
    assert sum(v for (_, s), v in sent.items() if s == "b") == pytest.approx(40)
    assert sent[("d",), "d"] == pytest.approx(15)
    used = {p: sum(v for (q, _), v in sent.items() if q == p) for p in supply}
    cost = sum(sum(max(0, min(1, used[p] / w - k)) * w * c for k, c in enumerate((0, 1, 4))) for p, w in supply.items() if p != ("d",))
    assert cost == pytest.approx(15)  # 75 words wanted of 60: 15 of them a second time


def test_overlapping_sources_and_listed_limit(spark, monkeypatch):
    rows = [(i, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else ["c"], 10) for i in range(300)] + [(999, [], 5), (998, None, 5)]
    frame = spark.createDataFrame(rows, "doc_id bigint, m array<string>, size bigint")
    quotas = spark.createDataFrame([("a", 900.0), ("b", 1500.0), ("c", 2550.0)], "source string, quota double")
    first = rows_of(mixing.mix(frame, F.col("m"), F.col("size"), quotas), "doc_id", "repeats")
    taken = defaultdict(int)
    for i, times in first:
        taken["ab" if i % 3 < 2 and i < 998 else "c"] += 10 * times
    assert abs(taken["ab"] - 2400) <= 20 and abs(taken["c"] - 2550) <= 10 and dict(first)[999] == 0 and dict(first)[998] == 0
    monkeypatch.setattr(mixing, "LISTED_PATTERNS", 0)
    assert rows_of(mixing.mix(frame, F.col("m"), F.col("size"), quotas), "doc_id", "repeats") == first


# ---- Quality classifier


def test_marginals_against_enumeration():
    draw = np.random.default_rng(1)
    lines = np.array([3, 1, 4, 2])
    emission, transition = draw.normal(size=(10, 2)), draw.normal(size=(2, 2))
    got, pairs, _ = crf.forward_backward(emission, transition, lines)
    at, total = 0, np.zeros((2, 2))
    for n in lines:
        weight, mean, both = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for labels in np.ndindex(*[2] * n):
            value = np.exp(sum(emission[at + i, y] for i, y in enumerate(labels)) + sum(transition[a, b] for a, b in zip(labels, labels[1:])))
            weight += value
            for i, y in enumerate(labels):
                mean[i, y] += value
            for a, b in zip(labels, labels[1:]):
                both[a, b] += value
        assert np.allclose(got[at : at + n], mean / weight)
        total += both / weight
        at += n
    assert np.allclose(pairs, total)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = entry_points.queries()["op5_quality_crf"](spark, folder)
    labels = common.table(spark, folder, "labels")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_training_reads_lines_behind_the_200th(spark):
    same = "\n".join(f"plain line {i}" for i in range(200))
    rows = [(i, same + ("\nA long good sentence follows here, with words and a stop." if i % 2 else "\n#$|<> 1234 ||| $$$ ###") * 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int")
    scores = {r.doc_id: r.score for r in crf.quality_scores(docs, labels).collect()}
    assert min(scores[i] for i in scores if i % 2) > max(scores[i] for i in scores if i % 2 == 0)


def test_quality_of_odd_rows(spark, documents, nothing):
    labels = documents.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).dropDuplicates(["doc_id"])
    labels = labels.withColumn("quality", F.abs("quality"))
    got = crf.quality_scores(documents, labels).collect()
    assert len(got) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert {r.score for r in crf.quality_scores(documents, labels.limit(0)).collect()} == {0.5}
    assert crf.quality_scores(nothing, labels).count() == 0
    alone, together = crf.line_shares([b"a b\n\nC!"]), crf.line_shares([b"", b"a b\n\nC!", b"x\n"])
    assert np.allclose(alone[0], together[0][1:4]) and together[2].tolist() == [1, 3, 2]


# ---- Chat


def test_conversations_come_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "assistant", "no [/ANSWER]</s> \\l"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"),
            (4, 0, "system", None), (4, 1, "tool <</ROLE>>", "<s><<ROLE>> x"), (4, 2, None, ""), (None, 5, "user", "<|endoftext|>"), (5, 0, "assistant", LONG), (5, 0, "assistant", LONG),
            (6, None, "user", "a"), (6, 0, "assistant", "<s"), (7, 0, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in CLASHING})
    path = public_tokenizers.path("byte_bpe_50k.json")
    wanted = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        learned = "".join(t for *_, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        formatted = sum(len("".join(chat.format_turn(role, t))) for *_, role, t in turns)
        wanted[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), formatted)
    for size in (200_000, 40):  # one sequence a tree, and several
        sequences, places = chat.format_chats(frame, path, size)
        got = {r.conv_id: tuple(r)[1:] for r in chat.read_chats(sequences, places, path).collect()}
        assert got == wanted
    sequences, places = chat.format_chats(frame, path)
    tokens = sum(len(r.ids) for r in sequences.select("ids").collect())
    encoder = chat.ByteTokens(path)
    distinct = sorted({"".join(chat.format_turn("user", "hi")), *("".join(chat.format_turn(r[2] or "", r[3] or "")) for r in rows)})
    assert tokens < sum(len(encoder.encode(t)) for t in distinct) + len(encoder.encode(LONG)) + 200
    empty = chat.format_chats(frame.limit(0), path)
    assert chat.read_chats(*empty, path).count() == 0


def test_positions_and_attention():
    encoder = chat.ByteTokens(public_tokenizers.path("byte_bpe_50k.json"))
    nodes = {b"a": (b"", "user", "first turn", False), b"b": (b"a", "assistant", "left", True), b"c": (b"a", "assistant", "right", False), b"d": (b"c", "user", "more", True)}
    out = chat.lay_out(nodes, encoder)
    by_node = {s["node"]: s for s in out["segments"]}
    a, b, c, d = (by_node[k] for k in (b"a", b"b", b"c", b"d"))
    assert [s["node"] for s in out["segments"]] == [b"a", b"b", b"c", b"d"]
    assert b["attends"] == [{"start": 0, "stop": b["stop"]}]
    assert d["attends"] == [{"start": 0, "stop": a["stop"]}, {"start": c["start"], "stop": d["stop"]}]
    assert out["positions"][c["start"]] == out["positions"][b["start"]] == a["stop"]
    assert out["positions"][d["start"]] == a["stop"] + c["stop"] - c["start"]
    for text in ("", "\\", "\\l<s>[INST]", "<<SYS>> <</SYS>></s>", "é́中\x00"):
        assert chat.unescape(chat.escape(text)) == text and encoder.decode(encoder.encode(text)) == text
        assert not chat.CONTROL.sub("", chat.escape(text)).count("[INST]")


# ---- Perplexity


def literal_kneser_ney(texts, order):
    from collections import Counter

    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        data = b"\0" * (order - 1) + t
        counts[order].update(data[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n].update(g[1:] for g in counts[n + 1])
    cut = [None]
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            cut.append((0.5, 0.75, 0.9))
            continue
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
        cut.append(tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3))))

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 256
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        d = lambda c: cut[n][min(c, 3) - 1]
        total, c = sum(same.values()), same.get(gram, 0)
        return (max(c - d(c), 0) if c else 0) / total + sum(map(d, same.values())) / total * p(gram[1:])

    return p


def test_kneser_ney_against_the_definition(spark):
    texts = [b"abracadabra", b"abrakadabra abra", "éabé".encode(), b"aaaa bbb"]
    frame = spark.createDataFrame([(t.decode(),) for t in texts] + [(None,), ("",)], "text string")
    model = perplexity.kneser_ney(frame, order=3)
    p = literal_kneser_ney(texts, 3)
    arrays = perplexity.hash_arrays(model)
    assert all((np.diff(a[0]) > 0).all() and len(a[0]) <= 1 << perplexity.SLOT_BITS for a in arrays)
    scorer = perplexity.Scorer(arrays)
    probe = [b"abr", b"\0\0a", b"xab", b"abx", b"xyz", b"bra"]
    code = np.array([int.from_bytes(g, "big") for g in probe], np.uint64)
    assert np.allclose(scorer.logp(code), [np.log(p(g)) for g in probe], atol=1e-5)
    for context in (b"ab", b"ra"):
        assert sum(p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


@pytest.mark.parametrize("part", [1 << 22, 300])
def test_no_two_grams_share_a_probability(spark, monkeypatch, part):
    monkeypatch.setattr(perplexity, "SLOT_BITS", 6)
    monkeypatch.setattr(perplexity, "PART_GRAMS", part)
    draw = random.Random(6)
    rows = [(i, prose(60, draw), "en") for i in range(20)] + [(20, None, "en"), (21, "", "en"), (22, "é", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = perplexity.kneser_ney(frame)
    known = {r.gram: r.logp for r in model[-1].collect()}
    parts = perplexity.gram_parts(model[-1])
    assert (len(parts) > 2) == (part == 300)
    for r in perplexity.score_documents(frame, parts).collect():
        data = b"\0" * 4 + (rows[r.doc_id][1] or "").encode()
        wanted = [-known[int.from_bytes(data[i : i + 5], "big")] for i in range(len(data) - 4)]
        assert r.log_ppl == (pytest.approx(np.mean(wanted), abs=1e-5) if wanted else None)


def literal_rules(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in (text or "").encode().split(b"\n") if line.split()]
    repeated = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(inside)


def test_rules_against_the_definition(spark, documents, nothing):
    more = [(500, "é a b é a b\n#$|\n\n#$|\n <>", None, None, None), (501, "a a a a", "xx", None, None), (502, prose(60), "zz", None, None)]
    frame = documents.select("doc_id", "text", "lang").where(F.coalesce(F.length("text"), F.lit(0)) < 3000).unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text", "lang"))
    got = perplexity.quality_rules(frame).collect()
    known = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None)
    wanted = sorted((r.doc_id, *literal_rules(r.text)) for r in frame.collect() if r.doc_id is not None)
    assert known == wanted
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.lower <= r.weighed <= r.upper)
    assert perplexity.quality_rules(nothing).count() == 0


def test_strange_text_leaves_its_language_band(spark):
    draw = random.Random(4)
    rows = [(i, prose(100, draw), "en") for i in range(60)] + [(99, "".join(chr(draw.randint(33, 1000)) + " " * (i % 3 == 0) for i in range(900)), "en")]
    got = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not got[99] and sum(got.values()) >= 59


def test_bands_of_like_length_find_strange_long_texts(spark):
    draw = random.Random(9)
    rows = [(i, prose(60 + i % 5, draw), "en") for i in range(150)] + [(200 + i, prose(1500 + i, draw), "en") for i in range(40)]
    rows += [(300, " ".join(draw.choice(WORDS) if draw.random() < 0.9 else "".join(draw.choice("vwxyz") for _ in range(4)) for _ in range(1500)), "en")]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not got[300].kept and sum(r.kept for r in got.values()) >= 180
    assert got[200].upper - got[200].lower < got[0].upper - got[0].lower
    values = [got[200 + i].log_ppl for i in range(40)] + [got[300].log_ppl]
    low, high = np.percentile(values, [25, 75], method="inverted_cdf")
    assert got[300].upper == pytest.approx(high + 1.5 * (high - low))


# ---- Archive


def test_revisits_edge_cases(spark):
    full = {"content-type": "text/html", "etag": '"1"', "x": "old"}
    rows = [
        (1, "http://a/x", 10, 200, '"1"', "d1", full), (2, "HTTP://A:80/x/#f", 20, 304, 'W/"1"', None, {"x": "new", "content-type": "no", "date": "t"}),
        (3, "http://a/x?utm_source=q", 30, 304, '"2"', None, None), (4, "http://a/x", 10, 304, '"1"', None, None), (5, "http://a/x", 40, 304, None, "d1", None),
        (6, "http://a/x", 41, 304, None, "d2", None), (7, "http://a/x", 42, 304, None, None, None), (8, None, 50, 304, None, None, None), (9, "http://a/x", None, 304, None, None, None),
        (10, "http://b/", 5, 404, None, None, None), (11, "http://b", 9, 304, None, None, None), (12, "http://a/x", 41, 200, None, None, None), (13, "http://a/x", 41, 200, None, None, None),
        (2, "HTTP://A:80/x/#f", 20, 304, 'W/"1"', None, {"x": "new", "content-type": "no", "date": "t"}),
    ]
    schema = "record_id bigint, url string, time bigint, status int, etag string, last_modified string, headers map<string,string>"
    frame = spark.createDataFrame(rows, schema).withColumns({c: F.lit(1) for c in CLASHING})
    got = defaultdict(list)
    for r in warc.resolve_revisits(frame).collect():
        got[r.record_id].append((r.outcome, r.refers_to, r.headers))
    merged = {"content-type": "text/html", "etag": '"1"', "x": "new", "date": "t"}
    assert got[2] == [("resolved", 1, merged)] * 2
    assert [got[i][0][:2] for i in (3, 4, 5, 6, 7, 8, 9, 11)] == [
        ("changed", 1), ("missing", None), ("resolved", 1), ("changed", 1), ("resolved", 13), ("missing", None), ("missing", None), ("missing", None)
    ]
    assert got[5][0][2] == full and warc.resolve_revisits(frame.limit(0)).count() == 0


def test_many_ranges_give_the_same_answers(spark, monkeypatch):
    pages = common.table(spark, "/root/testdata/sf0.001", "pages")
    pages = pages.withColumn("url", F.concat(F.lit("http://h/"), F.col("page_id") % 3))
    records = warc.page_records(pages)
    one = rows_of(warc.resolve_revisits(records), "record_id", "refers_to", "outcome")
    monkeypatch.setattr(warc, "RANGE_ROWS", 5)
    assert rows_of(warc.resolve_revisits(records), "record_id", "refers_to", "outcome") == one


# ---- Packing


def test_ids_equal_the_tokenizer(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), packing.WordTokens(path)
    odd = ["a<|endoftext|>b It's 12ﬁ3 Ünï x́ é ΣΑΣ 中文 can't've\t\r\nǅ İi  y", "﻿a ''ll 'S don'T", "", " ", "x\x00y"]
    for text in [*odd, *(t or "" for t in TEXTS)]:
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def check_packing(rows, most=4096):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return bins


def test_packing_whole_documents(documents, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed(documents, path).collect()
    bins = check_packing(rows)
    assert len(bins) <= sum(r.length for r in rows) / 4096 + 1.5
    wanted = []
    for r in documents.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start : start + 4096]
            wanted.append((r.doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(wanted, key=str)
    assert packing.packed(nothing, path).count() == 0
    whole = packing.token_pieces(documents, path, with_ids=True).first()
    assert len(whole.ids) == whole.length


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(spark, rule):
    draw = random.Random(3)
    rows = [(i, 0, draw.randint(1, 900)) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint")
    got = packing.pack(frame, tokens=1000, documents=6, attention=500_000.0, weights=(1.0, 0.3, 0.5), rule=rule).collect()
    bins = check_packing(got, 1000)
    assert all(len(b) <= 6 and (sum(x * x for _, x in b) <= 500_000 or len(b) == 1) for b in bins.values())
    assert len(got) == len(rows)


def test_best_fit_is_tight():
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 4097, 2000).astype(float)
    bins = packing.best_fit(np.stack([lengths, np.ones(2000), lengths**2], 1), np.array([4096, 4096, 4096.0**2]), np.array([1.0, 0, 0]))
    assert bins.max() + 1 <= 1.02 * lengths.sum() / 4096 + 1


# ---- Repeats


def literal_repeats(docs):
    seen, out = set(), {}
    for key, text in sorted(docs):
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 99):
            window = text[p : p + 100]
            if window in seen:
                gone[p : p + 100] = True
            seen.add(window)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out[key] = (len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts(count=90):
    draw = random.Random(1)
    base = ["".join(draw.choice("ab é") for _ in range(draw.randint(0, 400))) for _ in range(6)]
    return [
        "".join(draw.choice(base)[draw.randint(0, 100) : draw.randint(100, 400)] if draw.random() < 0.7 else "x" * draw.randint(0, 260) for _ in range(draw.randint(0, 5)))
        for _ in range(count)
    ]


@pytest.mark.parametrize("limit", [5000, 12])
def test_repeats_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "GROUP_ROWS", limit)
    rows = [(i * 3 - 50, t) for i, t in enumerate(repeated_texts())] + [(900, None), (901, ""), (902, "short")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in CLASHING}).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(frame).collect()}
    assert got == literal_repeats([(i, (t or "").encode()) for i, t in rows])
    assert repeats.without_repeats(frame.limit(0)).count() == 0


def test_repeated_ids_and_null_ids(spark):
    a, b = prose(60, random.Random(1)), prose(60, random.Random(2))
    rows = [(1, a), (1, a), (2, b), (2, b + a), (None, a), (None, "y" * 300)]
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append((r.n_bytes, r.n_removed))
    size = len(a.encode())
    assert found[1] == [(size, 0)] * 2
    assert sorted(n for n, _ in found[2]) == sorted([len(b.encode()), len((b + a).encode())])
    assert sum(gone for _, gone in found[2]) >= len((b + a).encode()) - 100
    assert sorted(found[None]) == sorted([(size, size), (300, 299)])


def test_suffix_array_lists_every_maximal_repeat():
    text = [b"xabcabcdy", b"zabcdq", b"abc"]
    array = repeats.SuffixArray(text, least=1)
    joined = b"".join(text)
    suffixes = []
    for row, t in enumerate(text):
        suffixes += [(t[i:], sum(map(len, text[:row])) + i) for i in range(len(t))]
    assert [joined[s : s + 1] for s in array.suffix] == [s[:1] for s, _ in sorted(suffixes)]
    got = {(joined[array.suffix[a] : array.suffix[a] + n], b - a + 1) for n, a, b in array.maximal_repeats(2)}
    assert got == {(b"abc", 4), (b"abcd", 2)}


# ---- Pipeline and entry


def test_pipeline_stages_take_odd_rows(spark, documents, nothing):
    folder = "/root/testdata/sf0.001"
    for frame in (documents, nothing):
        docs = frame
        for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, docs, folder)
            if at + 1 < len(corpus_pipeline.STAGES):
                assert done.columns == docs.columns, name
            docs = corpus_pipeline.materialize(done, "stage")
        check_packing(docs.collect())
    assert docs.count() == 0


def jaccard_groups(docs, width=5, least=0.8):
    """Smallest id reachable over links of that similarity, all pairs compared."""

    def shingle_set(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", words) if w]
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}

    sets = {doc: shingle_set(text) for doc, text in docs}
    root = {doc: doc for doc in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {doc: low if r == high else r for doc, r in root.items()}
    return root


def test_near_copies_of_every_similarity_are_found(spark):
    """Planted pairs by class of similarity: at 0.8 and above at least 95 of 100 lose one, and
    pairs well below lose none."""
    draw = random.Random(8)
    names = [f"w{i}" for i in range(5000)]
    texts, pairs = [], []
    for at in range(300):
        words = [draw.choice(names) for _ in range(draw.randint(60, 400))]
        other = list(words)
        share = draw.choice([0.005, 0.01, 0.015, 0.02, 0.03, 0.06])
        for place in draw.sample(range(len(words)), max(1, int(share * len(words)))):
            other[place] = draw.choice(names)
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other))
        pairs.append(len(a & b) / len(a | b))
        texts += [" ".join(words), " ".join(other)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()}
    found = defaultdict(list)
    for at, similarity in enumerate(pairs):
        assert 2 * at in kept
        found["0.9" if similarity >= 0.9 else "0.85" if similarity >= 0.85 else "0.8" if similarity >= 0.8 else "below"].append(2 * at + 1 not in kept)
    assert all(len(found[c]) > 20 for c in ("0.9", "0.85", "0.8", "below")), {c: len(v) for c, v in found.items()}
    assert not any(found["below"])
    assert all(np.mean(found[c]) >= 0.95 for c in ("0.9", "0.85", "0.8")), {c: np.mean(v) for c, v in found.items()}


def test_pipeline_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    labels = {r.doc_id: r.quality for r in common.table(spark, folder, "labels").collect()}
    good = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, folder), "good")
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    single = corpus_pipeline.materialize(corpus_pipeline.near_copies(spark, good, folder), "single")
    groups = jaccard_groups([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(set(groups.values()))
    clean = corpus_pipeline.repeats(spark, single, folder).collect()
    wanted = literal_repeats([(r.doc_id, r.text.encode()) for r in single.collect()])
    assert {r.doc_id: len(r.text) for r in clean} == {r.doc_id: r.n_chars for r in clean}
    assert sum(len(r.text.encode()) for r in clean) <= sum(n - gone for n, gone, *_ in wanted.values())
    assert len(clean) == len(wanted)


def test_queries_are_registered(spark):
    names = [n for n in entry_points.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_points.queries()
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    got = entry_points.queries()["op8_revisits"](spark, folder).toPandas()
    want = con.execute(entry_points.oracle_sql()["op8_revisits"]).df()[list(got.columns)]
    clean = lambda f: sorted(tuple("-" if pd.isna(v) else str(int(v) if isinstance(v, float) else v) for v in r) for r in f.itertuples(index=False))
    assert clean(got) == clean(want)
