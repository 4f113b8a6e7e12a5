"""Brain volumes by slabs: headers are decoded from their bytes, planes read by offset, sparse voxels written plane by plane."""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..errors import ResourceError
from .npy import BATCH, PARTITION, listed, opened

#: Number types by their code in the two formats: fixed values.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MGH_TYPES = {0: "u1", 1: "i4", 3: "f4", 4: "i2"}
NIFTI_HEADER, NIFTI_START, MGH_START = 348, 352, 284


@dataclass
class Volume:
    """Where a volume's planes lie. shape is (x, y, z, frames), x fastest; affine takes cells to millimetres, row by row."""

    path: str
    shape: tuple[int, int, int, int]
    dtype: str
    start: int
    slope: float
    offset: float
    affine: np.ndarray

    @classmethod
    def of(cls, path: str) -> Volume:
        system, name = opened(path)
        with system.open_input_file(name) as f:
            raw = f.read(NIFTI_START)
        if raw[:2] == b"\x1f\x8b":
            raise ResourceError(f"{path} is compressed, so its slabs cannot be read alone")
        for order in "<>":
            if len(raw) >= NIFTI_HEADER and struct.unpack(f"{order}i", raw[:4])[0] == NIFTI_HEADER:
                return cls._nifti(path, raw, order)
        if len(raw) >= MGH_START and struct.unpack(">i", raw[:4])[0] == 1:
            return cls._mgh(path, raw)
        raise ResourceError(f"{path} is no volume of a known kind")

    @classmethod
    def _nifti(cls, path: str, raw: bytes, order: str) -> Volume:
        get = lambda kind, at: struct.unpack_from(f"{order}{kind}", raw, at)
        dim, (code,), pixel = get("8h", 40), get("h", 70), get("8f", 76)
        (start, slope, offset), (q_code, s_code) = get("3f", 108), get("2h", 252)
        if raw[344:347] != b"n+1" or code not in NIFTI_TYPES or not 1 <= dim[0] <= 7:
            raise ResourceError(f"{path} is not a single file of real numbers")
        affine = np.diag([*pixel[1:4], 1.0])
        if s_code > 0:
            affine = np.vstack([np.array(get("12f", 280)).reshape(3, 4), [0, 0, 0, 1]])
        elif q_code > 0:
            b, c, d, x, y, z = get("6f", 256)
            a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
            turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
            affine = np.eye(4)
            affine[:3, :3] = turn * [pixel[1], pixel[2], pixel[3] * (-1 if pixel[0] < 0 else 1)]
            affine[:3, 3] = x, y, z
        sizes = [max(1, dim[i]) if i <= dim[0] else 1 for i in range(1, 8)]
        slope, offset = (slope, offset) if slope and np.isfinite([slope, offset]).all() else (1.0, 0.0)
        return cls(path, (*sizes[:3], int(np.prod(sizes[3:]))), order + NIFTI_TYPES[code], int(start), slope, offset, affine)

    @classmethod
    def _mgh(cls, path: str, raw: bytes) -> Volume:
        x, y, z, frames, code = struct.unpack_from(">5i", raw, 4)
        if code not in MGH_TYPES or min(x, y, z, frames) < 1:
            raise ResourceError(f"{path} is not a volume of real numbers")
        # Without a position of its own a volume is coronal, 1 mm: the format's default.
        spacing, axes, centre = np.ones(3), np.array([[-1.0, 0, 0], [0, 0, -1.0], [0, 1.0, 0]]), np.zeros(3)
        if struct.unpack_from(">h", raw, 28)[0] > 0:
            v = np.array(struct.unpack_from(">15f", raw, 30))
            spacing, axes, centre = v[:3], v[3:12].reshape(3, 3), v[12:]
        affine = np.eye(4)
        affine[:3, :3] = axes.T * spacing
        affine[:3, 3] = centre - affine[:3, :3] @ (np.array([x, y, z]) / 2)
        return cls(path, (x, y, z, frames), ">" + MGH_TYPES[code], MGH_START, 1.0, 0.0, affine)


@dataclass
class Slab(InputPartition):
    volume: Volume | None
    frame: int
    low: int
    high: int


class SlabReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("partitionbytes", PARTITION))
        self.bounds = {"k": [0, None], "frame": [0, None]}
        self.chosen: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in ("k", "frame", "file") and isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.chosen[name] = self.chosen.get(name, values) & values
            elif name in self.bounds and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.bounds[name][0] = max(self.bounds[name][0], f.value + isinstance(f, GreaterThan))
            elif name in self.bounds and isinstance(f, LessThan | LessThanOrEqual):
                high, old = f.value + isinstance(f, LessThanOrEqual), self.bounds[name][1]
                self.bounds[name][1] = high if old is None else min(old, high)
            else:
                yield f

    def _wanted(self, name: str, n: int) -> list[int]:
        low, high = self.bounds[name]
        return [i for i in range(low, n if high is None else min(n, high)) if name not in self.chosen or i in self.chosen[name]]

    def partitions(self) -> list[Slab]:
        out = []
        paths = listed(self.path)
        if not paths:
            raise ResourceError(f"there are no volumes at {self.path!r}")
        for v in map(Volume.of, [p for p in paths if "file" not in self.chosen or p in self.chosen["file"]]):
            most = max(1, self.bytes // max(1, v.shape[0] * v.shape[1] * np.dtype(v.dtype).itemsize))
            for frame in self._wanted("frame", v.shape[3]):
                for k in self._wanted("k", v.shape[2]):
                    last = out[-1] if out else None
                    if last and (last.volume, last.frame, last.high) == (v, frame, k) and k - last.low < most:
                        last.high = k + 1
                    else:
                        out.append(Slab(v, frame, k, k + 1))
        return out or [Slab(None, 0, 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        v = partition.volume
        if v is None:
            return
        x, y, z, _ = v.shape
        plane = x * y * np.dtype(v.dtype).itemsize
        together = max(1, BATCH // max(1, 8 * x * y))
        system, name = opened(v.path)
        with system.open_input_file(name) as f:
            for k in range(partition.low, partition.high, together):
                n = min(together, partition.high - k)
                raw = f.read_at(n * plane, v.start + (partition.frame * z + k) * plane)
                if len(raw) < n * plane:
                    raise ResourceError(f"{v.path} ends early")
                values = np.frombuffer(raw, v.dtype).astype(float) * v.slope + v.offset
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (x * y)), pa.array(values))
                yield pa.record_batch([pa.array([v.path] * n), pa.array([partition.frame] * n, pa.int64()), pa.array(np.arange(k, k + n)), pa.array([x] * n, pa.int64()), lists], ["file", "frame", "k", "nx", "values"])


@dataclass
class Planes(WriterCommitMessage):
    name: str
    first: int
    count: int


class SlabWriter(DataSourceWriter):
    """Tasks write runs of planes, the commit puts header and runs together and gives the file its name."""

    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.shape = [int(n) for n in options["shape"].split(",")]
        self.affine = [float(a) for a in options["affine"].split(",")]

    def _mark(self) -> tuple[pafs.FileSystem, str]:
        system, name = opened(self.path)
        folder, base = posixpath.split(name)
        system.create_dir(folder, recursive=True)
        return system, f"{folder}/.{base}-{self.job}"

    def write(self, rows: Iterator) -> Planes:
        system, mark = self._mark()
        name, first, count = f"{mark}-{uuid.uuid4().hex}", None, 0
        with system.open_output_stream(name) as f:
            for r in rows:
                if first is not None and r["k"] != first + count:
                    raise ResourceError("planes must come in order, each once")
                first = r["k"] if first is None else first
                f.write(np.asarray(r["values"], "<f4").tobytes())
                count += 1
        return Planes(name, -1 if first is None else first, count)

    def commit(self, messages: list[Planes | None]) -> None:
        parts = sorted((m for m in messages if m and m.count), key=lambda m: m.first)
        system, mark = self._mark()
        if sum(m.count for m in parts) != self.shape[2] or any(m.first != sum(o.count for o in parts[:i]) for i, m in enumerate(parts)):
            self.abort(messages)
            raise ResourceError("planes are missing or come twice")
        raw = bytearray(NIFTI_START)
        struct.pack_into("<i", raw, 0, NIFTI_HEADER)
        struct.pack_into("<8h", raw, 40, 3, *self.shape, 1, 1, 1, 1)
        struct.pack_into("<2h", raw, 70, 16, 32)
        spacing = np.linalg.norm(np.array(self.affine).reshape(3, 4)[:, :3], axis=0)
        struct.pack_into("<8f", raw, 76, 1, *spacing, 1, 1, 1, 1)
        struct.pack_into("<3f", raw, 108, NIFTI_START, 1, 0)
        struct.pack_into("<2h", raw, 252, 0, 2)
        struct.pack_into("<12f", raw, 280, *self.affine)
        raw[344:348] = b"n+1\0"
        with system.open_output_stream(f"{mark}-whole") as f:
            f.write(bytes(raw))
            for m in parts:
                with system.open_input_stream(m.name) as g:
                    while chunk := g.read(BATCH):
                        f.write(chunk)
        system.move(f"{mark}-whole", opened(self.path)[1])
        self.abort(messages)

    def abort(self, messages: list[Planes | None]) -> None:
        system, mark = self._mark()
        folder, base = posixpath.split(mark)
        for i in system.get_file_info(pafs.FileSelector(folder)):
            if posixpath.basename(i.path).startswith(base):
                system.delete_file(i.path)


class SlabSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stimulake_volume"

    def schema(self) -> str:
        return "file string, frame long, k long, nx long, values array<double>"

    def reader(self, schema: StructType) -> SlabReader:
        return SlabReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SlabWriter:
        return SlabWriter(self.options)


def read_planes(spark: SparkSession, path: str, partition_bytes: int = PARTITION) -> DataFrame:
    """Uncompressed .nii and .mgh volumes (a path or glob) as (file, frame, k, nx, values): a row a plane, x fastest. Filters on file, frame and k
    are pushed into the source, for which this turns on the session's pushdown into Python sources."""
    spark.dataSource.register(SlabSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(SlabSource.name()).option("partitionbytes", str(partition_bytes)).load(path)


def voxels(planes: DataFrame) -> DataFrame:
    """(file, frame, i, j, k, value) of planes."""
    at = planes.select("file", "frame", "k", "nx", F.posexplode("values").alias("p", "value"))
    return at.select("file", "frame", (F.col("p") % F.col("nx")).alias("i"), F.floor(F.col("p") / F.col("nx")).alias("j"), "k", "value")


def masked(spark: SparkSession, path: str, mask: DataFrame) -> DataFrame:
    """Voxels of the cells (i, j, k) of a mask: only planes between its first and its last are read."""
    low, high = mask.agg(F.min("k"), F.max("k")).first()
    planes = read_planes(spark, path)
    planes = planes.where(F.lit(False)) if low is None else planes.where((F.col("k") >= low) & (F.col("k") <= high))
    return voxels(planes).join(mask.select(*[F.col(c).cast("long").alias(c) for c in "ijk"]).distinct(), ["i", "j", "k"])


def write_volume(cells: DataFrame, path: str, shape: tuple[int, int, int], affine: np.ndarray | None = None, fill: float = float("nan")) -> None:
    """Sparse cells (i, j, k, value) as a .nii volume of 32-bit numbers; cells that aren't given are ``fill``. A plane is put together in a task
    of its own, and the file has its name when all are done. Cells outside the shape are an error; of repeated ones the greatest value stays."""
    x, y, z = shape
    outside = cells.where(~(F.col("i").between(0, x - 1) & F.col("j").between(0, y - 1) & F.col("k").between(0, z - 1)))
    if not outside.isEmpty():
        raise ResourceError(f"there are cells outside {shape}")
    spark = cells.sparkSession
    own = cells.groupBy("k", (F.col("i") + x * F.col("j")).alias("p")).agg(F.max("value").alias("v")).groupBy("k").agg(F.collect_list(F.struct("p", F.col("v").cast("double").alias("v"))).alias("cells"))
    every = spark.range(z).withColumnRenamed("id", "k").join(own.withColumn("k", F.col("k").cast("long")), "k", "left")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                plane, found = np.full(x * y, fill), b.column(1).slice(i, 1).flatten()
                if len(found):
                    plane[found.field(0).to_numpy(zero_copy_only=False).astype(int)] = found.field(1).to_numpy(zero_copy_only=False)
                yield pa.record_batch([b.column(0).slice(i, 1), pa.ListArray.from_arrays(pa.array([0, x * y], pa.int32()), pa.array(plane))], ["k", "values"])

    spark.dataSource.register(SlabSource)
    top = np.eye(4)[:3] if affine is None else np.asarray(affine, float)[:3]
    planes = every.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(dense, "k long, values array<double>")
    planes.write.format(SlabSource.name()).mode("append").option("shape", f"{x},{y},{z}").option("affine", ",".join(map(str, top.ravel().tolist()))).save(path)
