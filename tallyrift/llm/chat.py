"""Chat formatting on a prefix tree.

Conversations that begin with the same turns share those turns' tokens. A node is a turn
together with all turns before it (a chained hash), so equal beginnings are equal nodes. The
tree is written depth first: every node's tokens once, with position ids that continue along
the path and, per node, the intervals of the sequence it may attend to: its ancestors and
itself. Trees beyond a size are cut into several sequences that each repeat the ancestors
they need, so a first turn that everybody shares does not gather everybody in one task.

Texts are escaped: a control string inside a text loses its first character to an escape,
and the escape character doubles, so the template can be read back exactly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyrift.llm.common import sorted_groups
from tallyrift.session import materialize

SEQUENCE_CHARS, GROUPED_ROWS = 200_000, 2000
# Fixed: the marks of the template.
HEAD = {"user": "<s>[INST] ", "assistant": "<s>[ANSWER] ", "system": "<s><<SYS>> "}
TAIL = {"user": " [/INST]</s>", "assistant": " [/ANSWER]</s>", "system": " <</SYS>></s>"}
OTHER_HEAD, OTHER_MIDDLE, OTHER_TAIL = "<s><<ROLE>> ", " <</ROLE>> ", " <</TEXT>></s>"
CONTROL = re.compile(r"\\|<(?=/?s>|<(?:/?SYS|/?ROLE|/TEXT)>>)|\[(?=/?(?:INST|ANSWER)\])")
ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
PLAIN = {v: k for k, v in ESCAPED.items()}
TURN = re.compile(
    r"<s>\[INST\] (?P<user>.*?) \[/INST\]</s>|<s>\[ANSWER\] (?P<assistant>.*?) \[/ANSWER\]</s>|<s><<SYS>> (?P<system>.*?) <</SYS>></s>"
    r"|<s><<ROLE>> (?P<role>.*?) <</ROLE>> (?P<text>.*?) <</TEXT>></s>",
    re.S,
)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lb]", lambda m: PLAIN[m[0]], text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before, in and behind a turn's text."""
    if role in HEAD:
        return HEAD[role], escape(text), TAIL[role]
    return OTHER_HEAD + escape(role) + OTHER_MIDDLE, escape(text), OTHER_TAIL


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; it must be nothing but turns."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        role = found.lastgroup if found.lastgroup != "text" else unescape(found["role"])
        turns.append((role, unescape(found[found.lastgroup])))
        at = found.end()
    return turns


class ByteTokens:
    """A byte-level vocabulary: ids of a text and, exactly, the bytes of ids."""

    def __init__(self, path: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        self.bytes = {i: bytes(byte[c] for c in token) for token, i in self.tokenizer.get_vocab(False).items() if all(c in byte for c in token)}

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node, parent, root and depth of every turn; rows come sorted by conversation and turn."""
    conversation, node, root, depth = object(), b"", b"", 0
    for batch in batches:
        nodes, parents, roots, depths = [], [], [], []
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != conversation:
                conversation, node, depth = conv, b"", 0
            role_bytes = role.encode()
            digest = hashlib.sha256(node + len(role_bytes).to_bytes(8, "little") + role_bytes + text.encode()).digest()[:16]
            parents.append(node)
            node = digest
            root = node if not depth else root
            nodes.append(node)
            roots.append(root)
            depths.append(depth)
            depth += 1
        columns = [pa.array(x, pa.binary()) for x in (nodes, parents, roots)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *columns, pa.array(depths, pa.int32())], ["conv_id", "role", "text", "node", "parent", "root", "depth"]
        )


SEGMENT = "node binary, parent int, start int, stop int, position int, ends boolean, attends array<struct<start:int,stop:int>>"


def lay_out(nodes: dict[bytes, tuple], encoder: ByteTokens) -> dict:
    """One sequence of a set of nodes (``parent, role, text, ends``) that holds all parents:
    ids, position ids, loss mask and segments, depth first, siblings by hash."""
    children: dict[bytes, list[bytes]] = {}
    for node in sorted(nodes):
        children.setdefault(nodes[node][0], []).append(node)
    ids: list[int] = []
    positions: list[int] = []
    loss: list[int] = []
    segments: list[dict] = []
    stack = [(node, -1) for node in reversed(children.get(b"", []))]
    while stack:
        node, above = stack.pop()
        parent = segments[above] if above >= 0 else None
        _, role, text, ends = nodes[node]
        head, body, tail = format_turn(role, text)
        start = len(ids)
        for part, masked in ((head, 0), (body, int(role == "assistant")), (tail, 0)):
            part_ids = encoder.encode(part)
            ids += part_ids
            loss += [masked] * len(part_ids)
        stop = len(ids)
        first = parent["position"] + parent["stop"] - parent["start"] if parent else 0
        positions += range(first, first + stop - start)
        attends = [dict(i) for i in parent["attends"]] if parent else []
        if attends and attends[-1]["stop"] == start:
            attends[-1]["stop"] = stop
        else:
            attends.append({"start": start, "stop": stop})
        segments.append({"node": node, "parent": above, "start": start, "stop": stop, "position": first, "ends": ends, "attends": attends})
        stack += [(child, len(segments) - 1) for child in reversed(children.get(node, []))]
    return {"ids": ids, "positions": positions, "loss": loss, "segments": segments}


def _laid_out(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokens(path)
        for rows in sorted_groups(batches, "sequence_id", GROUPED_ROWS):
            groups: dict[int, dict] = {}
            for row in zip(*(rows.column(c).to_pylist() for c in ("sequence_id", "node", "parent", "role", "text", "ends"))):
                groups.setdefault(row[0], {})[row[1]] = row[2:]
            for sequence, nodes in groups.items():
                out = lay_out(nodes, encoder)
                kinds = {"ids": pa.list_(pa.int32()), "positions": pa.list_(pa.int32()), "loss": pa.list_(pa.int8())}
                segment = pa.struct(
                    [("node", pa.binary()), ("parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("position", pa.int32()), ("ends", pa.bool_()),
                     ("attends", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sequence], pa.int64()), *(pa.array([out[c]], k) for c, k in kinds.items()), pa.array([out["segments"]], pa.list_(segment))],
                    ["sequence_id", *kinds, "segments"],
                )

    return run


def format_chats(rows: DataFrame, path: str, sequence_chars: int = SEQUENCE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Sequences (``sequence_id, ids, positions, loss, segments``) and, per conversation, its
    place (``conv_id, sequence_id, node``): it is what the node's ``attends`` intervals show.

    ``rows`` has ``conv_id, turn, role, text``. A null role or text is empty, a null id is one
    conversation, turns with equal numbers follow in the order of role and text, repeated
    rows are turns of their own. No rows give no sequences."""
    turns = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = rows.schema["conv_id"].dataType.simpleString()
    chained = ordered.mapInArrow(_chain, f"conv_id {kind}, role string, text string, node binary, parent binary, root binary, depth int")
    chained = materialize(chained, "turns")
    nodes = materialize(chained.select("node", "parent", "root", "role", "text").dropDuplicates(["node"]), "nodes")
    sizes = nodes.groupBy("root").agg(F.sum(F.length("text") + 32).alias("_chars"))
    parts = sizes.select("root", F.greatest(F.ceil(F.col("_chars") / sequence_chars), F.lit(1)).alias("_parts"))
    leaves = chained.groupBy("conv_id").agg(F.max_by(F.struct("node", "root"), "depth").alias("_last")).select("conv_id", "_last.node", "_last.root")
    sequence = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("_parts")))
    places = materialize(leaves.join(parts, "root").select("conv_id", sequence.alias("sequence_id"), "node"), "places")
    ends = places.select("sequence_id", "node").distinct().withColumn("ends", F.lit(True))
    path_nodes = chained.select("conv_id", "node").join(
        places.select(F.col("conv_id").alias("_conv"), "sequence_id"), F.col("conv_id").eqNullSafe(F.col("_conv"))
    )
    used = path_nodes.select("sequence_id", "node").distinct().join(ends, ["sequence_id", "node"], "left")
    used = used.join(nodes, "node").select("sequence_id", "node", "parent", "role", "text", F.coalesce("ends", F.lit(False)).alias("ends"))
    laid = used.repartition("sequence_id").sortWithinPartitions("sequence_id")
    schema = f"sequence_id bigint, ids array<int>, positions array<int>, loss array<tinyint>, segments array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in SEGMENT.split(', ')))}>>"
    return materialize(laid.mapInArrow(_laid_out(path), schema), "sequences"), places


def _read_back(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteTokens(path)
        for batch in batches:
            out: list[tuple] = []
            for sequence, ids, loss, segments in zip(*(batch.column(c).to_pylist() for c in ("sequence_id", "ids", "loss", "segments"))):
                mask = np.array(loss, np.int8)
                for segment in segments:
                    if not segment["ends"]:
                        continue
                    spans = [(i["start"], i["stop"]) for i in segment["attends"]]
                    shown = [x for a, b in spans for x in ids[a:b]]
                    masked = np.concatenate([mask[a:b] for a, b in spans])
                    formatted = encoder.decode(shown)
                    turns = read_turns(formatted)
                    cuts = np.flatnonzero(np.diff(np.concatenate(([0], masked, [0]))))
                    learned = "".join(unescape(encoder.decode(shown[a:b])) for a, b in zip(cuts[::2], cuts[1::2]))
                    whole = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                    out.append((sequence, segment["node"], len(turns), whole.hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["sequence_id", "node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def read_chats(sequences: DataFrame, places: DataFrame, path: str) -> DataFrame:
    """Every conversation read back from the sequences: ``conv_id`` and digests of its turns
    and of the text under the loss mask."""
    schema = "sequence_id bigint, node binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    read = sequences.select("sequence_id", "ids", "loss", "segments").mapInArrow(_read_back(path), schema)
    return places.join(materialize(read, "read"), ["sequence_id", "node"]).drop("sequence_id", "node")
