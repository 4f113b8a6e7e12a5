"""Array files as tables: a data source that reads ranges of rows by offset, and writes parts that appear when all are done.

A file's header says where each row lies, so tasks seek to their rows instead of loading files; a filter on ``row`` or ``file`` and a range of
columns decide what is read at all. Files may have any size, and any file system that Arrow can open serves.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import ResourceError

#: Bytes of a partition, and of a batch that a task hands on.
PARTITION, BATCH = 1 << 26, 1 << 23


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


@dataclass
class Header:
    """Where a file's rows lie: the first index counts rows, the others are flattened."""

    path: str
    dtype: str
    rows: int
    width: int
    start: int

    @classmethod
    def of(cls, path: str) -> Header:
        system, name = opened(path)
        with system.open_input_file(name) as f:
            try:
                version = np.lib.format.read_magic(f)
                shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            except ValueError as e:
                raise ResourceError(f"{path} is no array file: {e}") from e
            if fortran and len(shape) > 1:
                raise ResourceError(f"{path} is stored by columns, so its rows cannot be read alone")
            if dtype.hasobject or dtype.kind not in "biuf":
                raise ResourceError(f"{path} does not hold numbers")
            rows = shape[0] if shape else 1
            return cls(path, dtype.str, rows, int(np.prod(shape[1:])) if shape else 1, f.tell())


def listed(path: str) -> list[str]:
    """The files of a path or glob (in its last part), by name; of a folder its .npy files."""
    system, name = opened(path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    folder, pattern = posixpath.split(name.rstrip("/"))
    if system.get_file_info(name).type == pafs.FileType.Directory:
        folder, pattern = name.rstrip("/"), "*.npy"
    if system.get_file_info(folder).type != pafs.FileType.Directory:
        return []
    found = [i.path for i in system.get_file_info(pafs.FileSelector(folder)) if i.type == pafs.FileType.File and fnmatch.fnmatch(posixpath.basename(i.path), pattern)]
    return sorted(prefix + p for p in found)


@dataclass
class Rows(InputPartition):
    header: Header
    #: Ranges of rows, ascending.
    runs: list[tuple[int, int]] = field(default_factory=list)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ResourceError("a path is needed")
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", PARTITION))
        low, _, high = (options.get("columns") or ":").partition(":")
        self.columns = (int(low or 0), int(high) if high else None)
        self.low, self.high = 0, None
        self.chosen: set[int] | None = None
        self.files: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("row",) and isinstance(f, EqualTo | EqualNullSafe | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.chosen = values if self.chosen is None else self.chosen & values
            elif name == ("row",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("row",) and isinstance(f, LessThan | LessThanOrEqual):
                high = f.value + isinstance(f, LessThanOrEqual)
                self.high = high if self.high is None else min(self.high, high)
            elif name == ("file",) and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.files = values if self.files is None else self.files & values
            else:
                yield f

    def partitions(self) -> list[Rows]:
        paths = listed(self.path)
        if not paths:
            raise ResourceError(f"there are no array files at {self.path!r}")
        out = []
        for header in map(Header.of, [p for p in paths if self.files is None or p in self.files]):
            low, high = self.low, header.rows if self.high is None else min(self.high, header.rows)
            if self.chosen is None:
                runs = [(low, high)] if low < high else []
            else:
                runs = [(r, r + 1) for r in sorted(r for r in self.chosen if r is not None and low <= r < high)]
            size = max(1, self.bytes // max(1, header.width * np.dtype(header.dtype).itemsize))
            own, held = [], 0
            for a, b in runs:
                while a < b:
                    n = min(b - a, size - held)
                    if own and own[-1][1] == a:
                        own[-1] = (own[-1][0], a + n)
                    else:
                        own.append((a, a + n))
                    a, held = a + n, held + n
                    if held == size:
                        out.append(Rows(header, own))
                        own, held = [], 0
            if own:
                out.append(Rows(header, own))
        return out or [Rows(Header("", "<f8", 0, 0, 0))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = partition.header
        if not partition.runs:
            return
        dtype = np.dtype(h.dtype)
        low, high = self.columns[0], h.width if self.columns[1] is None else min(self.columns[1], h.width)
        width, whole = max(0, high - low), (low, high) == (0, h.width)
        together = max(1, BATCH // max(8, 8 * width))
        system, name = opened(h.path)
        with system.open_input_file(name) as f:
            for a, b in partition.runs:
                for begin in range(a, b, together):
                    n = min(together, b - begin)
                    at = lambda row: h.start + (row * h.width + low) * dtype.itemsize  # noqa: B023, E731
                    raw = f.read_at(n * h.width * dtype.itemsize, at(begin)) if whole else b"".join(f.read_at(width * dtype.itemsize, at(begin + i)) for i in range(n))
                    values = np.frombuffer(raw, dtype).astype(float)
                    if len(values) != n * width:
                        raise ResourceError(f"{h.path} ends early")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
                    yield pa.record_batch([pa.array([h.path] * n), pa.array(np.arange(begin, begin + n)), lists], ["file", "row", "values"])


@dataclass
class Part(WriterCommitMessage):
    names: tuple[str, ...]
    first: int | None


class NpyWriter(DataSourceWriter):
    """Each task writes two hidden files, values and their row numbers; the commit renames all, in order of their first rows."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        if {"row", "values"} - set(schema.names):
            raise ResourceError("columns row and values are needed")
        self.folder, self.schema, self.job = options["path"], schema, uuid.uuid4().hex
        system, name = opened(self.folder)
        if not overwrite and system.get_file_info(name).type != pafs.FileType.NotFound:
            raise ResourceError(f"{self.folder!r} is there already")
        self.old = [i.path for i in system.get_file_info(pafs.FileSelector(name)) if i.path.endswith(".npy")] if system.get_file_info(name).type == pafs.FileType.Directory else []
        system.create_dir(name, recursive=True)

    def write(self, rows: Iterator) -> Part:
        system, name = opened(self.folder)
        mark = f"{name.rstrip('/')}/.{self.job}-{uuid.uuid4().hex}"
        numbers, width, first = [], None, None
        body = f"{mark}.body"
        with system.open_output_stream(body) as f:
            for r in rows:
                values = np.asarray(r["values"], float)
                width = len(values) if width is None else width
                if len(values) != width:
                    raise ResourceError("all rows must have the same length")
                numbers.append(r["row"])
                f.write(values.tobytes())
        if not numbers:
            system.delete_file(body)
            return Part((), None)
        first = min(numbers)
        for end, shape in (("values", (len(numbers), width)), ("rows", (len(numbers),))):
            with system.open_output_stream(f"{mark}.{end}") as f:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f8" if end == "values" else "<i8", "fortran_order": False, "shape": shape})
                if end == "rows":
                    f.write(np.array(numbers, "<i8").tobytes())
                else:  # the header holds the number of rows, so the body follows it only now
                    with system.open_input_stream(body) as g:
                        while chunk := g.read(BATCH):
                            f.write(chunk)
        system.delete_file(body)
        return Part((f"{mark}.values", f"{mark}.rows"), first)

    def commit(self, messages: list[Part | None]) -> None:
        system, name = opened(self.folder)
        for path in self.old:
            system.delete_file(path)
        for i, m in enumerate(sorted((m for m in messages if m and m.names), key=lambda m: (m.first, m.names))):
            for path, end in zip(m.names, ("npy", "index")):
                system.move(path, f"{name.rstrip('/')}/part-{i:05d}.{end}")

    def abort(self, messages: list[Part | None]) -> None:
        system, name = opened(self.folder)
        for i in system.get_file_info(pafs.FileSelector(name)):
            if posixpath.basename(i.path).startswith(f".{self.job}-"):
                system.delete_file(i.path)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stimulake_npy"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, schema, overwrite)


def read_npy(spark: SparkSession, path: str, columns: tuple[int, int] | None = None, partition_bytes: int = PARTITION) -> DataFrame:
    """Arrays in .npy files (a path, folder or glob) as (file, row, values): a row per first index, the rest flattened, or its ``columns``.

    Filters on row and file are pushed into the source, for which this turns on the session's pushdown into Python sources. Files must lie
    where all executors see them. No pickle is read.
    """
    spark.dataSource.register(NpySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NpySource.name()).option("partitionbytes", str(partition_bytes))
    if columns:
        reader = reader.option("columns", f"{columns[0]}:{columns[1]}")
    return reader.load(path)


def write_npy(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Rows (row, values) as part-N.npy files in a new folder (``overwrite``: in place of its arrays), each with its row numbers beside it as
    part-N.index. Parts get their names when all tasks are done, so a reader sees none or all; a task that runs twice leaves nothing behind."""
    df.sparkSession.dataSource.register(NpySource)
    df.select("row", "values").write.format(NpySource.name()).mode(mode).save(folder)
