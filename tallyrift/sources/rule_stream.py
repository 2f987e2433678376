"""Rule lines of any length as a Spark data source.

The lines are those of ``exchange``: ``item,item;score;value,value``. There a rule's values are one
cell; here they are rows in front of and behind the file, which is written and read in
pieces of about a megabyte, so a line may be longer than a cell or a task's memory. A line is written and
read by one task, many lines by many. Folders must be on a file system that pyarrow opens (local or
shared paths, or what its URIs name); ``exchange`` covers compressed files and Hadoop-only ones."""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyrift.operators.matching import RuleSet
from tallyrift.operators.ranking import number_rows
from tallyrift.session import materialize
from tallyrift.sources.exchange import escaped, unescaped

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

FORMAT = "tallyrift_rule_lines"
READ = pa.schema(
    [("file", pa.string()), ("at", pa.int64()), ("items", pa.string()), ("score", pa.string()), ("target", pa.int64()), ("n", pa.int64())]
)
READ_DDL = "file string, at bigint, items string, score string, target bigint, n bigint"
HEAD = re.compile(rb"([^;\n]*);([^;,\n]+)[;,]")
PIECE_BYTES, RANGE_BYTES, PIECE_COPIES = 1 << 20, 64 << 20, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """Lines that begin in these bytes of a file."""

    path: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class RuleLineReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Range]:
        system, path = opened(self.folder)
        found = system.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.folder)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path))
        shown = sorted((f for f in files if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda f: f.path)
        ranges = [Range(f.path, at, min(at + RANGE_BYTES, f.size)) for f in shown for at in range(0, f.size, RANGE_BYTES)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            with opened(self.folder)[0].open_input_file(partition.path) as file:
                yield from read_range(file, partition)


def read_range(file, partition: Range) -> Iterator[pa.RecordBatch]:
    """One row for the head of every line (its values null), then rows of its values (its head null)."""
    rest, ended = b"", False

    def more() -> None:
        nonlocal rest, ended
        piece = file.read(PIECE_BYTES)
        rest, ended = rest + piece, not piece

    def batch(at: int, items: str | None, score: str | None, target: list, n: list) -> pa.RecordBatch:
        rows = len(target)
        columns = [[partition.path] * rows, [at] * rows, [items] * rows, [score] * rows, target, n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, READ.types)], schema=READ)

    if partition.start:  # the line that this range begins in belongs to the range before
        file.seek(partition.start - 1)
        while b"\n" not in rest and not ended:
            rest = b""
            more()
        rest = rest.partition(b"\n")[2]
    while (at := file.tell() - len(rest)) < partition.stop:
        while not ended and not (head := HEAD.match(rest)) and b"\n" not in rest:
            more()
        head = HEAD.match(rest)
        if not head:
            line, _, rest = rest.partition(b"\n")
            if line.strip():
                raise ValueError(f"no rule line: {line[:1000].decode(errors='replace')}")
            continue
        yield batch(at, head[1].decode(), head[2].decode(), [None], [None])
        rest, whole = rest[head.end() :], False
        while not whole:
            if b"\n" not in rest and not ended:
                values, comma, behind = rest.rpartition(b",")
                rest = behind
                more()
            else:
                values, _, rest = rest.partition(b"\n")
                whole = True
            if entries := values.strip():
                pairs = [e.partition(b"*") for e in entries.split(b",")]
                yield batch(at, None, None, [int(t) for t, _, _ in pairs], [int(n) if star else 1 for _, star, n in pairs])


class RuleLineWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows ``head, entry, copies`` in order; a row with a head begins a line."""
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get().partitionId()
        hidden, final = f"{folder}/.{self.run}-{uuid.uuid4().hex}", f"{folder}/part-{task:06d}-{self.run}.txt"
        begun, first = False, True
        with system.open_output_stream(hidden) as file:
            for batch in iterator:
                pieces: list[str] = []
                for head, entry, copies in zip(*(batch.column(name).to_pylist() for name in ("head", "entry", "copies"))):
                    if head is not None:
                        pieces.append(("\n" if begun else "") + head + ";")
                        begun, first = True, True
                        continue
                    while copies > 0:
                        some = min(copies, PIECE_COPIES)
                        pieces.append(("" if first else ",") + ",".join([entry] * some))
                        first, copies = False, copies - some
                        if len(pieces) > 1 and some == PIECE_COPIES:
                            file.write("".join(pieces).encode())
                            pieces = []
                file.write("".join(pieces).encode())
            if begun:
                file.write(b"\n")
        return Written(hidden, final)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        before = system.get_file_info(fs.FileSelector(folder)) if self.overwrite else []
        for message in messages:
            if message:
                system.move(message.hidden, message.final)
        for old in before:
            if old.is_file and not old.base_name.startswith("."):
                system.delete_file(old.path)
        self._clean(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.folder)
        self._clean(system, folder)

    def _clean(self, system: fs.FileSystem, folder: str) -> None:
        """Remove what tasks of this run left that were lost or came second."""
        for left in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if left.is_file and left.base_name.startswith(f".{self.run}"):
                system.delete_file(left.path)


class RuleLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ_DDL

    def reader(self, schema) -> RuleLineReader:
        return RuleLineReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RuleLineWriter:
        return RuleLineWriter(self.options["path"], overwrite)


def write_rule_stream(rules: RuleSet, path: str, counted: bool = True, mode: str = "error") -> None:
    """Write one line per rule, best first, files in order. ``counted=False`` writes every
    copy of a value. ``mode`` is ``error`` (the folder must hold no files), ``append`` or ``overwrite``.
    A rule without values is a line that ends behind its score."""
    spark = rules.rules.sparkSession
    system, folder = opened(path)
    if mode == "error" and any(f.is_file for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))):
        raise FileExistsError(path)
    name = F.concat_ws(";", F.array_join(F.transform("itemset", escaped), ","), F.col("score").cast("string"))
    heads = rules.rules.select("position", F.lit(None).cast("bigint").alias("target"), name.alias("head"), F.lit(None).cast("bigint").alias("n"))
    cells = rules.values.join(rules.rules.select("itemset", "position"), "itemset")
    rows = heads.unionByName(cells.select("position", "target", F.lit(None).cast("string").alias("head"), "n"))
    ordered = rows.repartitionByRange("position").sortWithinPartitions("position", F.col("head").isNull(), "target")
    entry = F.col("target").cast("string")
    if counted:
        entry = F.concat_ws("*", entry, F.col("n").cast("string"))
    spark.dataSource.register(RuleLines)
    lines = ordered.select("head", entry.alias("entry"), (F.lit(1).cast("bigint") if counted else F.col("n")).alias("copies"))
    lines.write.format(FORMAT).mode("append" if mode == "error" else mode).save(path)


def read_rule_stream(spark: SparkSession, path: str) -> RuleSet:
    """Read what ``write_rule_stream`` or ``exchange.write_rule_lines`` wrote, in whatever
    pieces. As there, items are sorted, of several lines for one rule the last one counts, empty lines are
    skipped and a line that is no rule ends the job."""
    spark.dataSource.register(RuleLines)
    rows = materialize(spark.read.format(FORMAT).load(path), "rule-stream")
    place = F.struct("file", "at")
    heads = rows.filter(F.col("items").isNotNull()).select(
        F.array_sort(F.transform(F.split("items", ","), unescaped)).alias("itemset"), place.alias("place"), F.col("score").cast("double")
    )
    last = materialize(heads.groupBy("itemset").agg(F.max_by(F.struct("place", "score"), "place").alias("last")).select("itemset", "last.*"), "heads")
    rules = number_rows(last, [F.col("place")], "position")
    counts = rows.filter(F.col("items").isNull()).groupBy("file", "at", "target").agg(F.sum("n").alias("n"))
    values = counts.join(last.select("itemset", "place.file", "place.at"), ["file", "at"]).select("itemset", "target", "n")
    return RuleSet(rules.select("itemset", "score", "position"), values)
