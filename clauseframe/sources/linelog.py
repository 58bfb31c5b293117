"""A log of JSON lines as a Spark data source, for reports of progress: batch and streaming reads, and sinks that commit.

``spark.dataSource.register(LineLog)`` makes it known; then ``format("line_log")`` with the option ``path``, a folder by any URI that Arrow opens
(a local path, hdfs://, s3://). A log is a list of numbered entries in ``path/_log``, each one file that names data files of lines and may hold an
end: an object of type ``result`` or ``error``. Nothing is read that no entry names, so what a task that failed or ran twice has written is never seen.

Reads give (entry, part, at, value): the entry's number from 0, the file's place in it, the byte where the line begins, and the line. An entry's end is its
last row, with ``part`` behind the files. A file is read in ranges of ``range_bytes``, each a task of its own. As a stream, the offset is the
number of entries. Writes take the column ``value``: one JSON object a row; nulls are left out, and a text with a line break is refused, as it is not one line.

A batch write is one entry and ends it with ``result``, or with ``error`` if a task failed. A streaming write makes entry n of batch n, so a batch that is
repeated after a failure is written once; such a log has one writer. A batch writer takes the next number that is free.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "entry long, part int, at long, value string"
RANGE_BYTES = 64 * 2**20
#: Lines of one Arrow batch that a task gives.
BATCH_LINES = 10_000


class Folder:
    """The log's folder: its entries in order, and how one is added."""

    def __init__(self, where: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(where) if "://" in where else (pyarrow.fs.LocalFileSystem(), os.path.abspath(where))

    def entry_path(self, n: int) -> str:
        return f"{self.path}/_log/{n:020d}.json"

    def count(self) -> int:
        """Entries 0, 1, ... as far as there is no gap; found by doubling steps, without a listing."""
        there = lambda n: self.fs.get_file_info(self.entry_path(n)).type == pyarrow.fs.FileType.File
        if not there(0):
            return 0
        step = 1
        while there(step):
            step *= 2
        low, high = step // 2, step  # the entry ``low`` is there, ``high`` is not
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return high

    def entry(self, n: int) -> dict:
        with self.fs.open_input_stream(self.entry_path(n)) as f:
            return json.loads(f.read())

    def add(self, n: int, files: list[tuple[str, int]], end: dict | None) -> bool:
        """Makes entry ``n``, whole, in one step that does not replace a file; False if there is one."""
        whole = f"{self.path}/_log/_{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/_log", recursive=True)
        with self.fs.open_output_stream(whole) as f:
            f.write(json.dumps({"files": files, "end": end}).encode())
        try:
            if self.fs.type_name == "local":
                os.link(whole, self.entry_path(n))
            elif self.fs.get_file_info(self.entry_path(n)).type == pyarrow.fs.FileType.File:
                return False
            else:
                self.fs.move(whole, self.entry_path(n))
            return True
        except FileExistsError:
            return False
        finally:
            if self.fs.get_file_info(whole).type == pyarrow.fs.FileType.File:
                self.fs.delete_file(whole)

    def append(self, files: list[tuple[str, int]], end: dict | None) -> int:
        n = self.count()
        while not self.add(n, files, end):
            n += 1
        return n


@dataclass
class Written(WriterCommitMessage):
    """A task's file, its size and its lines; no file if it had none."""

    file: str | None
    size: int
    lines: int


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes ``start`` to ``end`` of a file, or an entry's end."""

    entry: int
    part: int
    file: str | None
    start: int
    end: int
    text: str | None = None


def ranges(folder: Folder, first: int, last: int, size: int) -> list[InputPartition]:
    """What entries ``first`` up to ``last``, exclusive, hold."""
    out: list[InputPartition] = []
    for n in range(first, last):
        told = folder.entry(n)
        out += [Range(n, part, file, at, min(at + size, total)) for part, (file, total) in enumerate(told["files"]) for at in range(0, total, size)]
        if told["end"] is not None:
            out.append(Range(n, len(told["files"]), None, 0, 0, json.dumps(told["end"], ensure_ascii=False)))
    return out


def lines_of(folder: Folder, r: Range) -> Iterator[tuple[int, str]]:
    """(byte, line). A line belongs to the range in which it begins, so a range skips what the one before it goes on reading."""
    with io.BufferedReader(folder.fs.open_input_file(f"{folder.path}/{r.file}"), 2**20) as f:
        at = max(r.start - 1, 0)
        f.seek(at)
        if r.start:
            at += len(f.readline())
        while at < r.end:
            line = f.readline()
            yield at, line.rstrip(b"\n").decode()
            at += len(line)


def batches(where: str, r: InputPartition) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([r.entry] * n, pa.int64()), pa.array([r.part] * n, pa.int32()), pa.array([a for a, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["entry", "part", "at", "value"])

    if r.file is None:
        yield batch([(0, r.text)])
        return
    rows = []
    for row in lines_of(Folder(where), r):
        rows.append(row)
        if len(rows) == BATCH_LINES:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


class Batches(DataSourceReader):
    def __init__(self, where: str, size: int):
        self.where, self.size = where, size

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.where)
        # a log without entries still has to have a partition, which holds nothing
        return ranges(folder, 0, folder.count(), self.size) or [Range(0, 0, None, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.file is not None or partition.text is not None:
            yield from batches(self.where, partition)


class Stream(DataSourceStreamReader):
    def __init__(self, where: str, size: int):
        self.where, self.size = where, size

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        return {"entries": Folder(self.where).count()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(Folder(self.where), start["entries"], end["entries"], self.size)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return batches(self.where, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back for a reader, so nothing is let go."""


def put(where: str, column: int, rows: Iterator[pa.RecordBatch]) -> Written:
    """Writes a task's lines to a file of its own."""
    folder, name, size, n, out = Folder(where), f"data/{uuid.uuid4().hex}.ndjson", 0, 0, None
    try:
        for batch in rows:
            lines = [v for v in batch.column(column).to_pylist() if v is not None]
            if any("\n" in v for v in lines):
                raise ValueError("a value with a line break is not one line")
            if not lines:
                continue
            if out is None:
                folder.fs.create_dir(f"{folder.path}/data", recursive=True)
                out = folder.fs.open_output_stream(f"{folder.path}/{name}")
            data = "".join(f"{v}\n" for v in lines).encode()
            out.write(data)
            size, n = size + len(data), n + len(lines)
    finally:
        if out is not None:
            out.close()
    return Written(name if out is not None else None, size, n)


def files_of(messages: list[WriterCommitMessage | None]) -> list[tuple[str, int]]:
    return [(m.file, m.size) for m in messages if m is not None and m.file is not None]


class Sink(DataSourceArrowWriter):
    def __init__(self, where: str, column: int):
        self.where, self.column = where, column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return put(self.where, self.column, iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        Folder(self.where).append(files_of(messages), {"type": "result", "lines": sum(m.lines for m in messages if m is not None)})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sum(m is not None for m in messages)
        Folder(self.where).append([], {"type": "error", "message": f"{done} of {len(messages)} tasks finished"})


class StreamSink(DataSourceStreamArrowWriter):
    def __init__(self, where: str, column: int):
        self.where, self.column = where, column

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return put(self.where, self.column, iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        Folder(self.where).add(batchId, files_of(messages), None)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        """The batch will come again, so the log says nothing of it."""


class LineLog(DataSource):
    """``format("line_log")``; options ``path`` and, for reads, ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "line_log"

    def schema(self) -> str:
        return SCHEMA

    @property
    def where(self) -> str:
        if not self.options.get("path"):
            raise ValueError("line_log needs the option path")
        return self.options["path"]

    @property
    def size(self) -> int:
        return int(self.options.get("range_bytes", RANGE_BYTES))

    @staticmethod
    def value_of(schema: StructType) -> int:
        at = [i for i, f in enumerate(schema.fields) if f.name == "value" and f.dataType.simpleString() == "string"]
        if not at:
            raise ValueError("line_log writes a string column named value")
        return at[0]

    def reader(self, schema: StructType) -> DataSourceReader:
        return Batches(self.where, self.size)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Stream(self.where, self.size)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("line_log only appends")
        return Sink(self.where, self.value_of(schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return StreamSink(self.where, self.value_of(schema))


def end(where: str, message: dict) -> int:
    """Ends a log that a stream has written with a line of type ``result`` or ``error``; the number of that entry. A stream must not go on then."""
    if message.get("type") not in ("result", "error"):
        raise ValueError("a log ends with a result or an error")
    return Folder(where).append([], message)
