"""Matrices in blocks: products, sums of outer products and triangular factors, none of which meets whole in one place.

A matrix is a DataFrame of rows with an array of doubles, or of column blocks (j, m: COLUMNS by something, row by row, as bytes). Memory of
a task follows a block's size, a batch of rows (Spark's bound in bytes) and the square of the *smaller* side, never that of the features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError

#: Columns of a block, elements of an operand of a block product, and bytes of sums that a task holds before it hands them on.
COLUMNS, ELEMENTS, HELD = 4096, 1 << 22, 1 << 27
#: Numbers of a matrix that is broadcast to the rows instead of rows being dealt to its blocks.
LIGHT = 1 << 20


def doubles(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix; all lists must have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    width = len(flat) // max(1, len(column)) if width is None else width
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise InvalidParameterError("all arrays must have the same length")
    return flat.reshape(len(column), width)


def batches_of(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def summed(parts: DataFrame, keys: list[str], m: str = "m") -> DataFrame:
    """Sums matrices of doubles, given as bytes, by key: in two levels, so that a key with many parts isn't one task's."""
    groups = max(1, math.isqrt(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, first = None, None, None
        for b in batches:
            listed = list(zip(*(b.column(c).to_pylist() for c in range(b.num_columns - 1))))
            for i, key in enumerate(listed):
                part = np.frombuffer(b.column(b.num_columns - 1)[i].as_py())
                if key == now:
                    total = total + part
                    continue
                if now is not None:
                    yield pa.record_batch([*first, pa.array([total.tobytes()], pa.binary())], b.schema.names)
                now, total, first, names = key, part, [b.column(c).slice(i, 1) for c in range(b.num_columns - 1)], b.schema.names
        if now is not None:
            yield pa.record_batch([*first, pa.array([total.tobytes()], pa.binary())], names)

    def level(df: DataFrame) -> DataFrame:
        by = [*keys, "__part"]
        df = df.select(*by, m)
        return df.repartition(*by).sortWithinPartitions(*by).mapInArrow(add, df.schema)

    once = level(parts.withColumn("__part", F.spark_partition_id() % groups))
    return level(once.withColumn("__part", F.lit(0))).drop("__part")


def outer_sums(df: DataFrame, x: str, y: str | None, columns: int = COLUMNS, prepare: Callable[[np.ndarray], np.ndarray] | None = None, sketch: tuple[int, int] | None = None, basis=None) -> DataFrame:
    """(j, m): column blocks of the sum over rows of x yᵀ, summed inside tasks and then by block.

    ``prepare`` is applied to batches of x. Instead of y, a ``sketch`` (width, seed) takes x times a Gaussian matrix, which is made block by
    block wherever it is needed, and a ``basis``, a matrix that is broadcast, x times that.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for j in list(held):
                yield pa.record_batch([pa.array([j], pa.int64()), pa.array([held.pop(j).tobytes()], pa.binary())], ["j", "m"])

        for b in batches:
            if not b.num_rows:
                continue
            a = doubles(b.column(0))
            a = prepare(a) if prepare else a
            starts = range(0, a.shape[1], columns)
            if sketch:
                right = np.zeros((len(a), sketch[0]))
                for s in starts:
                    block = a[:, s : s + columns]
                    right += block @ gaussian_block(s // columns, block.shape[1], *sketch)
            elif basis is not None:
                right = a @ basis.value
            else:
                right = doubles(b.column(1))
            for s in starts:
                part = a[:, s : s + columns].T @ right
                held[s // columns] = held[s // columns] + part if s // columns in held else part
                if sum(v.nbytes for v in held.values()) > HELD:
                    yield from out()
        yield from out()

    chosen = df.select(x, *([y] if y else [])).dropna()
    return summed(chosen.mapInArrow(rows, "j long, m binary"), ["j"])


def gaussian_block(j: int, rows: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, j)).standard_normal((rows, width))


def r_factor(df: DataFrame, columns: list[str], ones: bool = False, top: int | None = None) -> np.ndarray:
    """R of a QR factorisation of all rows, whose columns are a 1 (if asked for) and the arrays in turn: a tree of QRs of blocks.

    Each task folds its batches into one triangle, groups of tasks fold theirs, the driver the rest: width² numbers each, so this is for tall
    and skinny matrices. With ``top``, only the first rows are kept, which suffice to solve for the columns after those.
    """

    def fold(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for block in blocks:
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
            r = r if top is None else r[:top]
        return r

    def give(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.record_batch([pa.array([r.shape[1]], pa.int32()), pa.array([r.tobytes()], pa.binary())], ["w", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from give(fold(np.hstack([*([np.ones((b.num_rows, 1))] if ones else []), *[doubles(c) for c in b.columns]]) for b in batches if b.num_rows))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from give(fold(np.frombuffer(r).reshape(-1, w) for b in batches for w, r in zip(*(c.to_pylist() for c in b.columns))))

    groups = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = df.select(*columns).dropna().mapInArrow(first, "w int, r binary").repartition(groups).mapInArrow(more, "w int, r binary").collect()
    r = fold(np.frombuffer(f["r"]).reshape(-1, f["w"]) for f in found)
    return np.zeros((0, 0)) if r is None else r


def block_r_factor(blocks: DataFrame, width: int) -> np.ndarray:
    """The same for a matrix in column blocks (j, m) whose transpose is tall: width is its shorter side."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0):
                yield pa.record_batch([batches_of(np.linalg.qr(np.frombuffer(m.as_py()).reshape(-1, width), mode="r"))], ["x"])

    return r_factor(blocks.select("m").mapInArrow(rows, "x array<double>"), ["x"])


def times(blocks: DataFrame, width: int, right: np.ndarray) -> DataFrame:
    """Column blocks (j, m) of a matrix times a small one on the shorter side."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(np.frombuffer(m.as_py()).reshape(-1, width) @ right).tobytes() for m in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["j", "m"])

    return blocks.select("j", "m").mapInArrow(rows, "j long, m binary")


def in_column_blocks(df: DataFrame, ids: list[str], x: str, columns: int = COLUMNS) -> DataFrame:
    """(ids, j, x): rows cut into column blocks."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / columns).cast("int"), F.lit(1)) - 1)
    return df.select(*ids, x, F.explode(starts).alias("__j")).select(*ids, F.col("__j").cast("long").alias("j"), F.slice(x, F.col("__j") * columns + 1, columns).alias(x))


def transposed(blocks: DataFrame, width: int) -> DataFrame:
    """(unit, j, w): the shorter side's columns as rows, one piece a column block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for j, m in zip(b.column(0).to_pylist(), b.column(1)):
                t = np.frombuffer(m.as_py()).reshape(-1, width).T
                yield pa.record_batch([pa.array(np.arange(width)), pa.array(np.full(width, j)), batches_of(t)], ["unit", "j", "w"])

    return blocks.select("j", "m").mapInArrow(rows, "unit long, j long, w array<double>")


def product(rows: DataFrame, keys: list[str], x: str, weights: DataFrame, columns: int = COLUMNS, size: int | None = None) -> DataFrame:
    """(keys, ublock, units, values): each row's array times the weights (unit, w or unit, j, w) of all units, one row a block of units.

    Rows and units are dealt to blocks by hash; each pair of blocks meets once, for each column block, in one dense product. A block holds so
    many rows or units that an operand has ELEMENTS numbers at most. A row travels once a block of units, weights once a block of rows. Arrays
    longer than ``columns`` are cut and their partial products summed by key: then keys must be unique. Rows with a null array don't count.
    Weights of LIGHT numbers or fewer are broadcast; then no row is shuffled.
    """
    right = weights if "j" in weights.columns else in_column_blocks(weights, ["unit"], "w", columns)
    d, many, n_units = right.agg(F.max(F.size("w")), F.max("j"), F.count_distinct("unit")).first()
    most = min(2048, size or 2048, max(1, ELEMENTS // max(1, d or 0)))
    if (d or 0) * ((many or 0) + 1) * n_units <= LIGHT:
        return _light_product(rows, keys, x, right, most)
    n_rows = rows.count()
    deal = lambda n, by: F.pmod(F.xxhash64(*by), F.lit(max(1, -(-n // most))))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // most)) - 1).cast("long")))
    left = rows.select(*keys, x, deal(n_rows, [*keys, x]).alias("rblock")).where(F.col(x).isNotNull())
    left = in_column_blocks(left, [*keys, "rblock"], x, columns).withColumn("ublock", every(n_units))
    right = right.select("unit", "w", "j", deal(n_units, ["unit"]).alias("ublock")).withColumn("rblock", every(n_rows))
    n_keys = len(keys)

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("unit")
        a, b = a.combine_chunks(), b.combine_chunks()
        own = [a.column(i) for i in range(n_keys)] + [a.column("ublock")]
        if not a.num_rows or not b.num_rows:
            empty = pa.nulls(a.num_rows, pa.list_(pa.float64()))
            return pa.table([c.slice(0, 0) for c in own] + [empty.slice(0, 0)], [*keys, "ublock", "values"])
        value = doubles(pa.concat_arrays(a.column(x).chunks)) @ doubles(pa.concat_arrays(b.column("w").chunks)).T
        return pa.table([*own, batches_of(value)], [*keys, "ublock", "values"])

    by = ["rblock", "ublock", "j"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(multiply, f"{kinds}{', ' if kinds else ''}ublock long, values array<double>")
    if many:
        parts = summed_rows(parts, [*keys, "ublock"])
    units = right.select("ublock", "unit").distinct().groupBy("ublock").agg(F.array_sort(F.collect_list("unit")).alias("units"))  # a block of units a row
    return parts.join(units, "ublock").select(*keys, "ublock", "units", "values")


def _light_product(rows: DataFrame, keys: list[str], x: str, weights: DataFrame, most: int) -> DataFrame:
    """product() of broadcast weights, where rows are."""
    pieces: dict = {}
    for r in weights.select("unit", "j", "w").orderBy("unit", "j").collect():  # LIGHT numbers at most
        pieces.setdefault(r["unit"], []).append(r["w"])
    units, n_keys = pa.array(list(pieces)), len(keys)
    shared = rows.sparkSession.sparkContext.broadcast(np.array([np.concatenate(p) for p in pieces.values()], float))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, len(units), most):
                own = units.slice(s, most)
                step = max(1, LIGHT // len(own))
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    value = doubles(b.column(n_keys), shared.value.shape[1]) @ shared.value[s : s + most].T
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(own)), own.take(pa.array(np.tile(np.arange(len(own)), b.num_rows))))
                    yield pa.record_batch([*b.columns[:n_keys], pa.array(np.full(b.num_rows, s // most)), lists, batches_of(value)], [*keys, "ublock", "units", "values"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keys).schema.fields)
    unit = weights.schema["unit"].dataType.simpleString()
    return rows.select(*keys, x).where(F.col(x).isNotNull()).mapInArrow(multiply, f"{kinds}ublock long, units array<{unit}>, values array<double>")


def summed_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums arrays by key."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            if not b.num_rows:
                continue
            b = b if left is None else pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
            listed = list(zip(*(b.column(c).to_pylist() for c in range(len(keys)))))
            start = [0] + [i for i in range(1, len(listed)) if listed[i] != listed[i - 1]]
            if len(start) > 1:
                done = b.slice(0, start[-1])
                at = np.array(start[:-1])
                yield pa.record_batch([*[done.column(c).take(pa.array(at)) for c in range(len(keys))], batches_of_lists(done.column(len(keys)), at)], [*keys, "values"])
            left = b.slice(start[-1])
        if left is not None:
            at = np.array([0])
            yield pa.record_batch([*[left.column(c).take(pa.array(at)) for c in range(len(keys))], batches_of_lists(left.column(len(keys)), at)], [*keys, "values"])

    parts = parts.select(*keys, "values")
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, parts.schema)


def batches_of_lists(column: pa.Array, starts: np.ndarray) -> pa.Array:
    """Sums of runs of lists that begin at ``starts``; lists of a run have one length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
    out = [flat[ends[a] : ends[b]].reshape(b - a, -1).sum(axis=0) for a, b in zip(starts, [*starts[1:], len(column)])]
    return pa.array([o.tolist() for o in out], pa.list_(pa.float64()))
