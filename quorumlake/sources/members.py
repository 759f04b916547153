"""A data source of JSON lines in gzip members, with a stamp.

``spark.read.format("json_members")`` reads folders that the same format has written (and
files of plain lines beside them): each file is a row of gzip members, each with whole
lines, and a list of its members lies beside it, so a task reads some members of a file
and nothing else.  A marker, given as an option, is looked for in the bytes before a line
becomes a row.  (Filters are not taken over from the plan: what a Python source has taken
over stays with the relation, and a frame that is used again without the filter would miss
rows.)  The stamp names dataset, schema version and number of lines; a reader that expects
another, or that finds members with another number of lines, refuses the folder.

Paths are what ``pyarrow.fs`` opens (file, hdfs, s3 and gs addresses); driver and
executors must see them alike.  An empty table is a stamp without files.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructType

#: Bytes of lines in a member, and of members (as they lie) that one task reads.
MEMBER_BYTES, TASK_BYTES = 8 << 20, 64 << 20
STAMP, LIST = "_stamp.json", ".members"
SCHEMA = StructType().add("value", StringType())


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _text(where: fs.FileSystem, path: str) -> str:
    with where.open_input_stream(path) as f:
        return f.read().decode()


@dataclass
class Written(WriterCommitMessage):
    lines: int


@dataclass
class Members(InputPartition):
    file: str
    #: (offset, bytes) of each member
    spans: list[tuple[int, int]]


class MemberWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.dataset, self.version = options["path"], options.get("dataset", ""), int(options.get("schema_version", "0"))
        self.member_bytes = int(options.get("member_bytes", MEMBER_BYTES))
        if overwrite:
            where, path = _at(self.path)
            where.delete_dir_contents(path, missing_dir_ok=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file a task, under a name of its own, so a task that is run again spoils none."""
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}.json.gz"
        spans, total, at, held, size = [], 0, 0, [], 0
        out = None

        def flush() -> None:
            nonlocal out, at, held, size
            if not held:
                return
            if out is None:
                out = where.open_output_stream(name, compression=None)
            raw = gzip.compress(b"\n".join(held) + b"\n", 6, mtime=0)
            out.write(raw)
            spans.append([at, len(raw), len(held)])
            at, held, size = at + len(raw), [], 0

        for batch in batches:
            for line in batch.column(0).cast(pa.binary()).to_pylist():
                if line is None or b"\n" in line:
                    raise ValueError("a line must be a text without a line break")
                held.append(line)
                size += len(line) + 1
                total += 1
                if size >= self.member_bytes:
                    flush()
        flush()
        if out is not None:
            out.close()
            with where.open_output_stream(name + LIST) as f:
                f.write(json.dumps(spans).encode())
        return Written(total)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        stamp = {"dataset": self.dataset, "schema_version": self.version, "row_count": sum(m.lines for m in messages if m)}
        with where.open_output_stream(f"{root}/{STAMP}") as f:
            f.write(json.dumps(stamp).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Without a stamp the folder is refused."""


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.markers = options["path"], [m for m in [options.get("marker")] if m]
        self.dataset, self.version = options.get("dataset"), options.get("schema_version")
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))

    def partitions(self) -> list[Members]:
        where, root = _at(self.path)
        try:
            stamp = json.loads(_text(where, f"{root}/{STAMP}"))
        except FileNotFoundError:
            raise ValueError(f"{self.path} has no stamp; write it again") from None
        want = (self.dataset if self.dataset is not None else stamp["dataset"], int(self.version) if self.version is not None else stamp["schema_version"])
        if (stamp["dataset"], stamp["schema_version"]) != want:
            raise ValueError(f"{self.path} holds {stamp['dataset']} of schema {stamp['schema_version']}, not {want[0]} of schema {want[1]}; write it again")
        out, lines = [], 0
        for info in where.get_file_info(fs.FileSelector(root)):
            name = info.path
            if info.base_name.startswith(("_", ".")) or name.endswith(LIST) or info.type != fs.FileType.File:
                continue
            beside = where.get_file_info(name + LIST)
            if beside.type == fs.FileType.NotFound:
                out.append(Members(name, [(0, info.size)]))  # plain lines, or members of others
                lines = None if lines is None else lines + self._count(where, name)
                continue
            spans, size = [], 0
            for offset, length, n in json.loads(_text(where, name + LIST)):
                spans.append((offset, length))
                size, lines = size + length, lines + n
                if size >= self.task_bytes:
                    out.append(Members(name, spans))
                    spans, size = [], 0
            if spans:
                out.append(Members(name, spans))
        if lines != stamp["row_count"]:
            raise ValueError(f"{self.path} should hold {stamp['row_count']} lines, not {lines}")
        return out or [Members("", [])]

    @staticmethod
    def _count(where: fs.FileSystem, name: str) -> int:
        with where.open_input_stream(name, compression=None) as f:
            raw = f.read()
        return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).count(b"\n")

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.spans:
            return
        where, _ = _at(self.path)
        marks = [m.encode() for m in self.markers]
        with where.open_input_file(partition.file) as f:
            for offset, length in partition.spans:
                raw = f.read_at(length, offset)
                if raw[:2] == b"\x1f\x8b":  # what is not packed is plain lines
                    raw = gzip.decompress(raw)
                lines = [line for line in raw.split(b"\n") if line and all(m in line for m in marks)]
                for i in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(lines[i:i + 10_000], pa.binary()).cast(pa.string())], ["value"])


class JsonMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_members"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MemberWriter:
        return MemberWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonMembers)


def write_members(lines: DataFrame, path: str, dataset: str, version: int, **options) -> None:
    """Write a table of one column of lines."""
    register(lines.sparkSession)
    named = lines.toDF("value")
    named.write.format("json_members").option("path", path).option("dataset", dataset).option("schema_version", version).options(**options).mode("append").save()


def read_members(spark: SparkSession, path: str, dataset: str, version: int, **options) -> DataFrame:
    """(value): the lines of a folder of that dataset and version."""
    register(spark)
    return spark.read.format("json_members").option("path", path).option("dataset", dataset).option("schema_version", version).options(**options).load()
