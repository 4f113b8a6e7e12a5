"""Principal components and least squares where features are too many for a matrix of features by features."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError
from .blocks import COLUMNS, HELD, LIGHT, batches_of, block_r_factor, doubles, outer_sums, product, r_factor, times, transposed
from .written import written

#: Features of which a triangle may be made; outputs that are solved together.
NARROW, OUTPUTS = 4096, 1024


def moments(df: DataFrame, x: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population variances of each column of an array: two numbers a column, as much as two rows."""

    def join(a: tuple | None, b: tuple) -> tuple:
        if a is None:
            return b
        n, delta = a[0] + b[0], b[1] - a[1]
        return n, a[1] + delta * (b[0] / n), a[2] + b[2] + delta * delta * (a[0] * b[0] / n)

    def give(t: tuple | None) -> Iterator[pa.RecordBatch]:
        if t is not None:
            yield pa.record_batch([pa.array([t[0]], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in t[1:]]], ["n", "mean", "m2"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                a = doubles(b.column(0))
                mean = a.mean(axis=0)
                total = join(total, (len(a), mean, ((a - mean) ** 2).sum(axis=0)))
        yield from give(total)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for n, mean, m2 in zip(*(c.to_pylist() for c in b.columns)):
                total = join(total, (n, np.frombuffer(mean), np.frombuffer(m2)))
        yield from give(total)

    kind = "n long, mean binary, m2 binary"
    total = None
    # Partial moments meet in groups of 16 before the driver, which holds one at a time.
    for r in df.select(x).dropna().mapInArrow(first, kind).coalesce(16).mapInArrow(more, kind).toLocalIterator():
        total = join(total, (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["m2"])))
    return (0, np.zeros(0), np.zeros(0)) if total is None else (total[0], total[1], total[2] / total[0])


@dataclass
class Components:
    """Principal components: weights (unit, j, w) with an offset each, so that a score is x·w + offset; variances and their shares."""

    weights: DataFrame
    offsets: np.ndarray
    variances: np.ndarray
    shares: np.ndarray

    def scores(self, df: DataFrame, x: str, keys: list[str]) -> DataFrame:
        """(keys, scores): of rows of any table with the same features."""
        p = product(df, keys, x, self.weights)
        offsets = F.lit(self.offsets.tolist())
        return p.select(*keys, F.zip_with("values", offsets, lambda v, o: v + o).alias("scores"))


def components(df: DataFrame, keys: list[str], x: str, k: int, standardise: bool = False, extra: int = 10, power: int = 2, seed: int = 0) -> Components:
    """The first k principal components of a table with any number of features, by a randomised range finder.

    The features' row space is sketched by AᵀA times a Gaussian matrix of k + extra columns, made block by block; ``power`` further rounds of AᵀA
    sharpen it; each time the basis, a matrix in column blocks, is made orthonormal by a tree of QRs. A's own product with the basis is
    reduced by a last tree of QRs, whose small factor gives the components. Centring (and, if asked for, scaling to variance 1; constant
    features stay) happens in tasks. Keys must be unique; rows with a null array don't count. In each component the largest weight is
    positive. With fewer rows or features than k there are as many components as the rank. A basis of LIGHT numbers or fewer is broadcast, so that
    no row is shuffled; rows meet a larger one in blocks.
    """
    rows = df.select(*keys, x).where(F.col(x).isNotNull())
    n, mean, var = moments(rows, x)
    if not n:
        return Components(df.sparkSession.createDataFrame([], "unit long, j long, w array<double>"), np.zeros(0), np.zeros(0), np.zeros(0))
    scale = np.where(var > 0, np.sqrt(var), 1.0) if standardise else np.ones(len(var))
    total = float((var / scale**2).sum())
    shared = df.sparkSession.sparkContext.broadcast((mean, scale))  # as large as two rows

    def centred(a: np.ndarray) -> np.ndarray:
        m, s = shared.value
        return (a - m) / s

    width = min(k + extra, n, len(mean))
    spread = outer_sums(rows, x, None, prepare=centred, sketch=(width, seed))
    basis, width = _orthonormal(written(spread, "sketch"), width)
    for _ in range(power):
        if width * len(mean) <= LIGHT:
            spread = outer_sums(rows, x, None, prepare=centred, basis=_broadcast(basis, width))
        else:
            spread = outer_sums(rows.join(_projected(rows, keys, x, basis, width, shared), keys), x, "values", prepare=centred)
        basis, width = _orthonormal(written(spread, "sketch"), width)
    r = r_factor(_projected(rows, keys, x, basis, width, shared), ["values"])
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    keep = s > (s[0] if len(s) else 0) * 1e-12
    s, vt = s[keep][:k], vt[keep][:k]
    best = written(times(basis, width, vt.T), "components")
    sign = _signs(best, len(s))
    weights, offsets = _folded(written(times(best, len(s), np.diag(sign)), "components"), len(s), shared)
    return Components(weights, offsets, s**2 / n, s**2 / n / total)


def _broadcast(basis: DataFrame, width: int):
    """A small basis as one matrix for all tasks."""
    found = sorted((r["j"], r["m"]) for r in basis.select("j", "m").collect())
    return basis.sparkSession.sparkContext.broadcast(np.vstack([np.frombuffer(m).reshape(-1, width) for _, m in found]))


def _orthonormal(blocks: DataFrame, width: int) -> tuple[DataFrame, int]:
    """An orthonormal basis of what the columns span, in column blocks, and its size; a second round mends what the first lost."""
    for _ in range(2):
        _, s, vt = np.linalg.svd(block_r_factor(blocks, width))
        keep = s > s[0] * 1e-13 if len(s) and s[0] > 0 else s > 0
        blocks, width = written(times(blocks, width, vt[keep].T / s[keep]), "basis"), int(keep.sum())
    return blocks, width


def _folded(basis: DataFrame, width: int, shared) -> tuple[DataFrame, np.ndarray]:
    """Weights for raw features, and offsets, that stand for a basis of centred and scaled ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        for b in batches:
            for j, w in zip(b.column(0).to_pylist(), b.column(1)):
                at = slice(j * COLUMNS, (j + 1) * COLUMNS)
                own = np.frombuffer(w.as_py()).reshape(-1, width) / s[at, None]
                yield pa.record_batch([pa.array([j], pa.int64()), pa.array([own.tobytes()], pa.binary()), batches_of(-(m[at] @ own)[None])], ["j", "m", "offset"])

    folded = basis.select("j", "m").mapInArrow(rows, "j long, m binary, offset array<double>")
    at = folded.select(F.posexplode("offset").alias("unit", "o")).groupBy("unit").agg(F.sum("o").alias("o")).orderBy("unit").collect()
    return transposed(folded, width), np.array([r["o"] for r in at])


def _projected(rows: DataFrame, keys: list[str], x: str, basis: DataFrame, width: int, shared) -> DataFrame:
    """(keys, values): centred rows times a basis."""
    weights, offsets = _folded(basis, width, shared)
    p = product(rows, keys, x, weights, size=max(width, 1))
    return written(p.select(*keys, F.zip_with("values", F.lit(offsets.tolist()), lambda v, o: v + o).alias("values")), "projected")


def _signs(blocks: DataFrame, width: int) -> np.ndarray:
    """+1 or -1 by the largest entry of each of the shorter side's columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in b.column(0):
                a = np.frombuffer(m.as_py()).reshape(-1, width)
                yield pa.record_batch([pa.array(np.arange(width)), pa.array(a[np.abs(a).argmax(axis=0), np.arange(width)])], ["c", "v"])

    found = blocks.select("m").mapInArrow(rows, "c long, v double").groupBy("c").agg(F.max_by("v", F.abs("v")).alias("v")).orderBy("c").collect()
    return np.array([1.0 if r["v"] >= 0 else -1.0 for r in found])


def least_squares(df: DataFrame, x: str, y: str, penalty: float = 0.0, rcond: float = 1e-13) -> DataFrame:
    """(unit, coef, intercept) of every output: the read-out that ``linalg.predict`` takes; unit is the output's place in the array y.

    A tree of QRs over the features with a 1 in front, whose Qᵀ is applied to the outputs, block of outputs by block, at each node; triangle
    and outputs are then solved on executors. So columns that nearly depend on each other cost the digits of their condition, not
    of its square, and nothing of outputs times features passes the driver. Directions below rcond of the largest count as none (the solution
    of least norm). A ridge penalty doesn't hold for the intercept. Rows with a null array don't count; without rows the table is empty.
    """
    rows = df.select(x, y).dropna()
    one = rows.select(F.size(x), F.size(y)).first()
    kind = "unit long, coef array<double>, intercept double"
    if one is None:
        return df.sparkSession.createDataFrame([], kind)
    d, outputs = one[0] + 1, one[1]
    if d > NARROW:
        raise InvalidParameterError(f"{d - 1} features are too many for a triangle of their own; take components first")
    together = max(1, HELD // (8 * d * OUTPUTS)) * OUTPUTS

    def first(begin: int):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r = q = None
            for b in batches:
                if b.num_rows:
                    a, v = np.hstack([np.ones((b.num_rows, 1)), doubles(b.column(0))]), doubles(b.column(1))[:, begin : begin + together]
                    r, q = _folded_once([(a, v)] if r is None else [(r, q), (a, v)])
            if r is not None:
                for j in range(0, q.shape[1], OUTPUTS):
                    yield _triangle(r, q[:, j : j + OUTPUTS], (begin + j) // OUTPUTS)

        return f

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for j, r, q in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if j != now and held:
                    yield _triangle(*held[0], now)
                    held = []
                r = np.frombuffer(r.as_py()).reshape(-1, d)
                now, held = j, [_folded_once([*held, (r, np.frombuffer(q.as_py()).reshape(len(r), -1))])]
        if held:
            yield _triangle(*held[0], now)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ridge = np.sqrt(penalty) * np.eye(d)[1:]
        for b in batches:
            for j, r, q in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                r = np.frombuffer(r.as_py()).reshape(-1, d)
                q = np.frombuffer(q.as_py()).reshape(len(r), -1)
                if penalty:
                    r, q = np.vstack([r, ridge]), np.vstack([q, np.zeros((d - 1, q.shape[1]))])
                w = np.linalg.lstsq(r, q, rcond=rcond)[0].T
                yield pa.record_batch([pa.array(np.arange(len(w)) + j * OUTPUTS), batches_of(w[:, 1:]), pa.array(w[:, 0])], ["unit", "coef", "intercept"])

    kinds = "j long, part int, r binary, q binary"
    groups = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = reduce(DataFrame.unionByName, [rows.mapInArrow(first(k), kinds) for k in range(0, max(1, outputs), together)])
    for part in (F.spark_partition_id() % groups, F.lit(0)):
        parts = parts.withColumn("part", part).repartition("j", "part").sortWithinPartitions("j", "part").mapInArrow(more, kinds)
    return parts.mapInArrow(solved, kind)


def _folded_once(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """R of stacked blocks, and Qᵀ applied to what stands beside them."""
    q, r = np.linalg.qr(np.vstack([a for a, _ in blocks]))
    return r, q.T @ np.vstack([b for _, b in blocks])


def _triangle(r: np.ndarray, q: np.ndarray, j: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array([j], pa.int64()), pa.array([0], pa.int32()), pa.array([r.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(q).tobytes()], pa.binary())], ["j", "part", "r", "q"])


def coefficient_table(coef: DataFrame) -> pd.DataFrame:
    """The coefficients of few outputs on the driver, by unit."""
    return coef.orderBy("unit").toPandas()
