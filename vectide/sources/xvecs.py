"""A Spark data source for fvecs and ivecs files.

A file is a run of records: a 32-bit count n, then n 32-bit floats (fvecs) or
integers (ivecs), little-endian. All records are of one length; a trailing part
of a record is ignored, as is customary for the format, but a record whose count
differs is an error.

``spark.read.format("xvecs").load(path)`` gives (id, vector) with id the number
of the record. A path is a file, or a folder whose files, in order of their names,
are parts of one table (what the writer leaves). Files are split into ranges of
whole records of about ``splitBytes`` bytes, so a large file is read by many
tasks. ``df.write.format("xvecs").save(folder)`` writes a part per task.

Options: ``kind`` (``fvecs`` or ``ivecs``; else by the file's name), ``splitBytes``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Element types of the two kinds of file.
ELEMENTS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int")}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files by name."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(inner, info.size)]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Records(InputPartition):
    """Records first .. first + count - 1 of a file; the first has the number ``id``."""

    file: str
    first: int
    count: int
    id: int

    def __init__(self, file: str, first: int, count: int, id: int):
        self.file, self.first, self.count, self.id = file, first, count, id


class XvecsReader(DataSourceReader):
    def __init__(self, path: str, kind: str, split: int):
        self.path, self.kind, self.split = path, kind, split
        self.dim = 0
        system, _ = file_system(path)
        for name, size in files_of(path):
            if size >= 4:
                with system.open_input_file(name) as f:
                    self.dim = struct.unpack("<i", f.read(4))[0]
                break
        if self.dim < 0:
            raise ValueError(f"{path}: not a file of vectors")

    def partitions(self) -> list[InputPartition]:
        length, out, number = 4 + 4 * self.dim, [], 0
        step = max(1, self.split // length)
        for name, size in files_of(self.path):
            n = size // length if self.dim else 0
            out += [Records(name, at, min(step, n - at), number + at) for at in range(0, n, step)]
            number += n
        return out or [Records("", 0, 0, 0)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = file_system(self.path)
        length, (code, _) = 4 + 4 * self.dim, ELEMENTS[self.kind]
        rows = max(1, (1 << 22) // length)
        with system.open_input_file(partition.file) as f:
            f.seek(partition.first * length)
            for at in range(0, partition.count, rows):
                n = min(rows, partition.count - at)
                data = np.frombuffer(f.read(n * length), "<i4").reshape(n, self.dim + 1)
                if (data[:, 0] != self.dim).any():
                    raise ValueError(f"{partition.file}: records of different lengths")
                flat = np.ascontiguousarray(data[:, 1:]).view(code).ravel()
                offsets = pa.array(np.arange(n + 1) * self.dim, pa.int32())
                ids = pa.array(np.arange(n) + partition.id + at, pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "vector"])


@dataclass
class Part(WriterCommitMessage):
    path: str


class XvecsWriter(DataSourceWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind = path, kind
        system, inner = file_system(path)
        if overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
            system.delete_dir_contents(inner) if system.get_file_info(inner).type == fs.FileType.Directory else system.delete_file(inner)
        system.create_dir(inner, recursive=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, inner = file_system(self.path)
        number = TaskContext.get().partitionId()
        # hidden until commit, so a retried task leaves nothing behind that is read
        name = f"{inner}/.part-{number:05d}-{uuid.uuid4().hex}.{self.kind}"
        code, dim = ELEMENTS[self.kind][0], None
        with system.open_output_stream(name) as out:
            for row in rows:
                v = np.asarray(row["vector"], code)
                if dim is not None and len(v) != dim:
                    raise ValueError("vectors must be of one length")
                dim = len(v)
                out.write(struct.pack("<i", dim) + v.tobytes())
        return Part(name)

    def commit(self, messages: list) -> None:
        system, inner = file_system(self.path)
        for m in messages:
            if m is not None:
                name = m.path.rsplit("/", 1)[1]
                system.move(m.path, f"{inner}/{name[1:11]}.{self.kind}")

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.path)


class XvecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xvecs"

    def _kind(self) -> str:
        path = self.options["path"]
        kind = self.options.get("kind") or next((k for k in ELEMENTS if path.rstrip("/").endswith(k)), None)
        if kind is None:
            try:
                kind = next((k for name, _ in files_of(path) for k in ELEMENTS if name.endswith(k)), "fvecs")
            except FileNotFoundError:
                kind = "fvecs"
        if kind not in ELEMENTS:
            raise ValueError(f"unknown kind {kind}")
        return kind

    def schema(self) -> str:
        return f"id bigint, vector array<{ELEMENTS[self._kind()][1]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return XvecsReader(self.options["path"], self._kind(), int(self.options.get("splitbytes", self.options.get("splitBytes", 64 << 20))))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return XvecsWriter(self.options["path"], self._kind(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``xvecs`` known to a session."""
    spark.dataSource.register(XvecsSource)
