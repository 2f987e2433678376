"""Conversation structure repair by divide and conquer.

A conversation has to read ``(s?(ua)+)?``: maybe a system turn, then users and assistants in
turn. Four states say where a reader of that pattern stands: nothing read, system read, user
read, assistant read. Edits move through rows and states at a cost; forward costs from the
start and backward costs from the end meet in the middle, the crossing state on the
audit-least cheapest way is taken, and both halves are solved alike. Only four numbers a
direction are held at a time, never a table of rows and states.

A conversation may be of any length: its rows are sorted by ranges and cut into units of at
most UNIT_ROWS rows. A unit's costs between any two states are sixteen numbers, which chain
(minimum of sums) along a conversation; every unit then knows what lies ahead and is solved
by itself, wherever it is."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrift.llm.common import gives_back
from tallyrift.session import materialize

UNIT_ROWS = 4096
KNOWN_UNITS = 1 << 14
NEVER = 1 << 60
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, MEND = 4, 3, 3, 3
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that an insertion or a new role gives in each state
FINAL = (0, 2 * INSERT, INSERT, 0)  # insertions that end the conversation properly
STATES = range(4)
BLANK_CLASS = r"\x20\x09-\x0D"
FAULTS = ("blank", "duplicate", "truncated")
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by the checksum of ``conv_id:turn``. Nulls
    count as one space there and in role and text; ids and turns stay null."""
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    marked = rows.select(
        "conv_id", "turn", said["role"].alias("role"), said["text"].alias("text"),
        (F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"])) % 20).alias("_fault"),
    ).where("_fault <> 0")
    fault = F.col("_fault")
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")
    ).drop("_copy")


# ---- One unit: marks are a letter a row, the role's initial; capital: truncated, dot: has to go


def _moves(mark: str, state: int) -> list[tuple[str, int, int]]:
    """``letter, next state, cost`` of the edits that take a row, letters ascending."""
    found = [("D", state, DELETE)]
    if mark != ".":
        more = MEND * mark.isupper()
        kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(mark.lower())
        if kept == NEXT[state] or kept == SYSTEM and state == START:
            found.append(("K", kept, more))
        found.append(("R", NEXT[state], REROLE + more))
    return found


MOVES = {mark: [_moves(mark, state) for state in STATES] for mark in "suaoSUAO."}


def _forward(costs: list[int], marks: str) -> list[int]:
    """Costs on arrival behind ``marks``, from costs on arrival before them."""
    for mark in marks:
        reached = list(costs)
        for _ in range(2):  # more than two insertions lead to a state that was there before
            for state in STATES:
                reached[NEXT[state]] = min(reached[NEXT[state]], reached[state] + INSERT)
        costs = [NEVER] * 4
        for state in STATES:
            for _, after, cost in MOVES[mark][state]:
                costs[after] = min(costs[after], reached[state] + cost)
    return costs


def _backward(costs: list[int], marks: str) -> list[int]:
    """Costs from arrival before ``marks`` on, given those from arrival behind them on."""
    for mark in reversed(marks):
        costs = [min(costs[after] + cost for _, after, cost in MOVES[mark][state]) for state in STATES]
        for _ in range(2):
            costs = [min(costs[state], costs[NEXT[state]] + INSERT) for state in STATES]
    return costs


def _least(marks: str, start: int, ahead: list[int]) -> int:
    """The state behind ``marks`` on the audit-least of the cheapest ways from ``start``.

    Edits of one state have different letters, so the least audit takes the least letter of
    those on a cheapest way; each state hands on where its own way ends."""
    ends, costs = list(STATES), ahead
    for mark in reversed(marks):
        before = _backward(costs, mark)
        found: list[int | None] = [None] * 4
        for state in (USER, ASSISTANT, USER, SYSTEM, START):  # an insertion looks at another state's answer
            for letter, after, cost in MOVES[mark][state]:
                if letter > "I" and before[state] == before[NEXT[state]] + INSERT:
                    found[state] = found[NEXT[state]]
                    break
                if before[state] == costs[after] + cost:
                    found[state] = ends[after]
                    break
            else:
                if before[state] == before[NEXT[state]] + INSERT:
                    found[state] = found[NEXT[state]]
        ends, costs = found, before
    return ends[start]


def _one(mark: str, start: int, end: int) -> str:
    ways, state = [], start
    for inserted in range(3):
        ways += [(INSERT * inserted + cost, "I" * inserted + letter) for letter, after, cost in MOVES[mark][state] if after == end]
        state = NEXT[state]
    return min(ways)[1]


def _between(marks: str, start: int, end: int) -> str:
    """The audit-least cheapest edits from ``start`` before ``marks`` to ``end`` behind them."""
    if len(marks) == 1:
        return _one(marks, start, end)
    middle = len(marks) // 2
    left, right = marks[:middle], marks[middle:]
    here = _forward([0 if state == start else NEVER for state in STATES], left)
    there = _backward_to(end, right)
    best = min(a + b for a, b in zip(here, there))
    tied = [state for state in STATES if here[state] + there[state] == best]
    cross = tied[0]
    if len(tied) > 1:
        cross = _least(left, start, [there[state] if state in tied else NEVER for state in STATES])
    return _between(left, start, cross) + _between(right, cross, end)


def _backward_to(end: int, marks: str) -> list[int]:
    return _backward([0 if state == end else NEVER for state in STATES], marks)


@functools.lru_cache(maxsize=KNOWN_UNITS)
def _solved(marks: str, start: int, ahead: tuple[int, ...]) -> tuple[int, str]:
    end = _least(marks, start, list(ahead))
    return end, _between(marks, start, end)


def unit_costs(marks: str) -> list[int]:
    """Least costs from each state before to each state behind a unit, sixteen numbers."""
    return [cost for start in STATES for cost in _forward([0 if s == start else NEVER for s in STATES], marks)]


def repair_marks(marks: str) -> tuple[int, str]:
    """Cost and audit of one whole conversation given as marks."""
    if not marks:
        return 0, ""
    cost = _backward(list(FINAL), marks)[START]
    end, audit = _solved(marks, START, FINAL)
    return cost, audit + "I" * (FINAL[end] // INSERT)


# ---- The table


def _in_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, pos``: sorted by conversation and turn (nulls first; equal
    turns by role and text: their first 32 letters, then a hash). Ranges may cut a
    conversation, equal rows too; ``pos`` counts up by one inside a range."""
    keyed = rows.select("conv_id", "turn", "role", "text").withColumns(
        {
            "_role": F.substring("role", 1, 32),
            "_text": F.substring("text", 1, 32),
            "_hash": F.xxhash64("role", "text"),
            "_row": F.monotonically_increasing_id(),
        }
    )
    order = ["conv_id", "turn", "_role", "_text", "_hash", "_row"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(
        ranged.select("conv_id", "turn", "role", "text").withColumn("pos", F.monotonically_increasing_id()), "turns"
    )


def _faults(ordered: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, initial, fault``; fault is blank, duplicate, truncated or null."""
    said = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("_said")
    rows = ordered.select(
        "conv_id", "turn", "pos", said, F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(f"[^{BLANK_CLASS}]")).alias("_blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANK_CLASS}]*\z")).alias("_open"),
    )
    again = (
        rows.groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_same"))
        .agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_same")), "left")
    fault = (
        F.when(F.col("_blank"), "blank")
        .when(F.col("pos") > F.col("_first"), "duplicate")
        .when(F.col("_open"), "truncated")
    )
    return met.select("conv_id", "turn", "pos", "initial", fault.alias("fault"))


def _units(faults: DataFrame) -> DataFrame:
    """A row per conversation and run of UNIT_ROWS positions: its ``marks``, first position,
    counts of faults and of illegal neighbours, and its outer initials."""
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), ".").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    count = {k: F.sum(F.when(F.col("fault") == k, 1).otherwise(0)).alias(k) for k in FAULTS}
    held = faults.groupBy("conv_id", F.floor(F.col("pos") / UNIT_ROWS).alias("unit")).agg(
        F.array_sort(F.collect_list(F.struct("pos", mark.alias("mark"), plain.alias("plain")))).alias("_rows"), *count.values()
    )  # at most UNIT_ROWS rows a group
    return held.select(
        "conv_id", "unit", F.array_join(F.transform("_rows", lambda r: r["mark"]), "").alias("marks"),
        F.get("_rows", F.lit(0))["pos"].alias("pos"), *FAULTS, _illegal(_neighbours("_rows", "plain", "plain")).alias("illegal"),
        F.get("_rows", F.lit(0))["plain"].alias("head"), F.element_at("_rows", -1)["plain"].alias("tail"),
    )


def _chained(units: DataFrame, kind: str) -> DataFrame:
    """``conv_id, unit, ahead`` of conversations of several units: the costs of all that
    follows each unit. One conversation's units meet, sixteen numbers for UNIT_ROWS rows."""

    @gives_back
    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [unit_costs(marks) for marks in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["conv_id", "unit", "costs"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows, ahead, found = rows.sort_values("unit", ascending=False), list(FINAL), []
        for unit in rows["costs"]:
            found.append(ahead)
            ahead = [min(unit[4 * start + end] + ahead[end] for end in STATES) for start in STATES]
        return pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "unit": rows["unit"].to_numpy(), "ahead": found})

    inside = units.select("conv_id", "unit", "marks").mapInArrow(costs, f"conv_id {kind}, unit bigint, costs array<bigint>")
    return inside.groupBy("conv_id").applyInPandas(chain, f"conv_id {kind}, unit bigint, ahead array<bigint>")


def _solve(units: DataFrame, kind: str) -> DataFrame:
    """``conv_id, unit, pos, marks, start, end, cost, audit`` for every state a unit may start in;
    a conversation's first unit starts in one. The last unit's audit ends the conversation."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, (m, a, first, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3, 7)))):
                costs = _backward(list(a), m)
                for start in (START,) if first else STATES:
                    end, audit = _solved(m, start, tuple(a))
                    found.append((at, start, end, costs[start], audit + "I" * (FINAL[end] // INSERT) * last))
            at, *columns = zip(*found) if found else [[] for _ in range(5)]
            known = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*known, *arrays], ["conv_id", "unit", "pos", "marks", "start", "end", "cost", "audit"])

    return units.select("conv_id", "unit", "pos", "marks", "ahead", "first", "last").mapInArrow(
        run, f"conv_id {kind}, unit bigint, pos bigint, marks string, start int, end int, cost bigint, audit string"
    )


def _walked(solved: DataFrame, kind: str) -> DataFrame:
    """``conv_id, unit, start`` of the one way through a conversation's units."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        state, found = START, []
        for unit, part in rows.sort_values("unit").groupby("unit", sort=True):
            found.append((unit, state))
            state = int(part.loc[part["start"] == state, "end"].iloc[0])
        unit, start = zip(*found)
        return pd.DataFrame({"conv_id": rows["conv_id"].to_numpy()[: len(unit)], "unit": unit, "start": start})

    return solved.select("conv_id", "unit", "start", "end").groupBy("conv_id").applyInPandas(walk, f"conv_id {kind}, unit bigint, start int")


def _joined(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on a conversation id that may be null, and on ``more``."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in ("conv_id", *more)})
    on = F.col("conv_id").eqNullSafe(F.col("_r_conv_id"))
    for c in more:
        on = on & (F.col(c) == F.col(f"_r_{c}"))
    return left.join(renamed, on, how).drop(*(f"_r_{c}" for c in ("conv_id", *more)))


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row per conversation, and its repaired turns.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` and ``conv_id, unit,
    step, edit, role, text`` (sort by unit and step; deleted rows are not in it). ``rows`` has
    ``conv_id, turn, role, text``; other columns are ignored, a null role or text counts as one
    space, a null id is a conversation of its own, null turns come first, repeated rows are
    rows. No rows give empty tables."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    clean = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    ordered = _in_order(clean)
    faults = _faults(ordered)
    units = materialize(_units(faults), "units")
    ends = units.groupBy("conv_id").agg(F.min("unit").alias("_min"), F.max("unit").alias("_max"))
    spread = _joined(units, ends).withColumns({"first": F.col("unit") == F.col("_min"), "last": F.col("unit") == F.col("_max")})
    single, several = spread.where("_min = _max"), spread.where("_min < _max")
    chains = materialize(_chained(several, kind), "ahead")
    ahead = F.array(*(F.lit(c).cast("bigint") for c in FINAL))
    ready = single.withColumn("ahead", ahead).unionByName(_joined(several, chains, "unit"))
    solved = materialize(_solve(ready, kind), "solved")
    long = ends.where("_min < _max")
    ways = materialize(_walked(_joined(solved, long), kind), "ways")
    lone = _joined(solved, long, how="left_anti")
    chosen = materialize(lone.unionByName(_joined(solved, ways, "unit", "start")), "chosen")
    return _summary(faults, units, chosen), _edits(chosen, ordered, kind)


def _illegal(pairs: Column) -> Column:
    return F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("bigint")


def _neighbours(rows: str, first: str, second: str) -> Column:
    """Letters of neighbouring elements of an array of structs; none of fewer than two."""
    both = F.transform(
        F.sequence(F.lit(1), F.size(rows) - 1), lambda i: F.concat(F.get(rows, i - 1)[first], F.get(rows, i)[second])
    )
    return F.when(F.size(rows) > 1, both).otherwise(F.array().cast("array<string>"))


def _summary(faults: DataFrame, units: DataFrame, chosen: DataFrame) -> DataFrame:
    turns = faults.select("conv_id", "turn").distinct()
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"))
    seams = F.array_sort(F.collect_list(F.struct("unit", "head", "tail")))  # one for UNIT_ROWS rows
    counts = units.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in (*FAULTS, "illegal")), seams.alias("_seams"))
    parts = F.array_sort(F.collect_list(F.struct("unit", "audit", "cost")))
    audits = chosen.groupBy("conv_id").agg(parts.alias("_parts")).select(
        "conv_id", F.get("_parts", F.lit(0))["cost"].alias("cost"),
        F.array_join(F.transform("_parts", lambda p: p["audit"]), "").alias("audit"),
    )
    return _joined(_joined(counts, gaps), audits).select(
        "conv_id", "gaps", *FAULTS, (F.col("illegal") + _illegal(_neighbours("_seams", "tail", "head"))).alias("illegal"), "cost", "audit"
    )


def _edits(chosen: DataFrame, ordered: DataFrame, kind: str) -> DataFrame:
    """The turns that stay. Every letter but ``I`` takes the unit's next row; the state gives
    the role that an insertion or a new role writes."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, (first, marks, state, audit) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                pos = first
                for step, letter in enumerate(audit):
                    row, pos = (None, pos) if letter == "I" else (pos, pos + 1)
                    if letter == "D":
                        continue
                    if letter == "K" and state == START and marks[pos - 1 - first] in "sS":
                        found.append((at, step, letter, row, None))
                        state = SYSTEM
                        continue
                    state = NEXT[state]
                    found.append((at, step, letter, row, None if letter == "K" else NAMES[state]))
            at, *columns = zip(*found) if found else [[] for _ in range(5)]
            known = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(2)]
            types = (pa.int64(), pa.string(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*known, *arrays], ["conv_id", "unit", "step", "edit", "pos", "given"])

    steps = chosen.select("conv_id", "unit", "pos", "marks", "start", "audit").mapInArrow(
        run, f"conv_id {kind}, unit bigint, step bigint, edit string, pos bigint, given string"
    )
    rows = ordered.select(F.col("pos").alias("_pos"), "role", "text")
    # inserted turns have no row to meet, and nulls would all meet in one task
    met = steps.where("pos is not null").join(rows, F.col("pos") == F.col("_pos")).select(
        "conv_id", "unit", "step", "edit", F.coalesce("given", "role").alias("role"), "text"
    )
    new = steps.where("pos is null").select("conv_id", "unit", "step", "edit", F.col("given").alias("role"), F.lit("").alias("text"))
    return met.unionByName(new)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired turns, ``role:text`` joined by newlines. A
    conversation's turns pass one task in order, as the hash demands; none is held."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(found):
            ids, codes = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(codes)], ["conv_id", "repaired_sha256"])

        here, state, found, types = None, None, [], []
        for batch in batches:
            types = [batch.schema.field(0).type]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if state is None or conv != here:
                    if state is not None:
                        found.append((here, state.hexdigest()))
                    here, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if found:
                yield done(found)
                found = []
        if state is not None:
            yield done([(here, state.hexdigest())])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "unit", "step")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired_digests(rows: DataFrame) -> DataFrame:
    """Damage ``rows``, repair them, and give every original conversation its counts, cost,
    audit and the hash of its repaired turns; without a row left: zeros, an empty audit, the
    hash of nothing."""
    summary, turns = repair_conversations(damaged(rows))
    found = _joined(_joined(rows.select("conv_id").distinct(), summary, how="left"), digests(turns), how="left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *FAULTS, "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
