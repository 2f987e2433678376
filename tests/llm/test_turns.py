"""Conversation repair against a search over all edits, and its edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyrift.llm import turns

ROWS = "conv_id bigint, turn bigint, role string, text string"
STEP = {"": "u", "s": "u", "u": "a", "a": "u"}  # the last role written -> the next to write


def cheapest(rows):
    """``cost, audit, turns`` by a search ordered by cost and audit. ``rows``: role, text, fault."""
    heap, done = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done[at, last] = cost, audit, out
        new = STEP[last]
        name = {"u": "user", "a": "assistant"}[new]
        heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*out, f"{name}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                kept = role[:1]
                if kept == new or kept == "s" and last == "":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, kept, (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, new, (*out, f"{name}:{text}")))
        if len(done) == 4 * (len(rows) + 1):
            break
    return min(done[end] for end in ((len(rows), ""), (len(rows), "a")) if end in done)


def literal_repair(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        here = conversations.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        here += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    found = {}
    for conv, held in conversations.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32]))
        seen, faults = set(), []
        for _, role, text in held:
            words = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
        known = [t for t, _, _ in held if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(held))
        cost, audit, out = cheapest([(role, text, fault) for (_, role, text), fault in zip(held, faults)])
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def conversations(draw):
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(draw.randint(1, 9)):
            at = draw.choice([None, turn, turn, turn, turn + 2])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, at, role, draw.choice(["Yes.", "No!", f"word {turn} {conv}", f"Done {draw.random()}.\n", " \t", "", None, "é?"])))
    return rows + rows[:5]


def result(frame):
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert frame.columns == ["conv_id", *columns]
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in columns) for r in rows}


@pytest.mark.parametrize("unit", [turns.UNIT_ROWS, 2])
def test_repair_equals_a_search(spark, monkeypatch, unit):
    monkeypatch.setattr(turns, "UNIT_ROWS", unit)
    rows = conversations(random.Random(3))
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("unit", "pos", "audit", "_fault")}).repartition(3)
    assert result(turns.repaired_digests(frame)) == literal_repair(rows)


def test_repair_of_a_long_conversation_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(turns, "UNIT_ROWS", 7)
    draw = random.Random(9)
    rows = [(1, turn, draw.choice(["user", "assistant", "system"]), f"line {turn}{draw.choice(['.', '', '!'])}") for turn in range(400)]
    rows += [(1, 399, "user", "same.")] * 40 + [(2, 0, "user", "x" * 200_000 + ".")]
    assert result(turns.repaired_digests(spark.createDataFrame(rows, ROWS).repartition(4))) == literal_repair(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], ROWS)
    assert result(turns.repaired_digests(empty)) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(turns.repaired_digests(spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS))) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_every_short_conversation():
    fault = {".": "blank"}
    for length in range(4):
        for marks in itertools.product("suaoSUA.", repeat=length):
            rows = [(m.lower(), "", fault.get(m, "truncated" if m.isupper() else None)) for m in marks]
            assert turns.repair_marks("".join(marks)) == cheapest(rows)[:2], marks


def test_long_marks_in_linear_space():
    draw = random.Random(1)
    marks = "".join(draw.choice("suaoSUAO.") for _ in range(300))
    rows = [(m.lower(), "", "blank" if m == "." else "truncated" if m.isupper() else None) for m in marks]
    assert turns.repair_marks(marks) == cheapest(rows)[:2]
