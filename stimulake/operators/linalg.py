"""Linear models: one distributed Gram matrix, a small solve on the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError
from ..functions.columns import dot
from .blocks import product
from .wide import NARROW, coefficient_table, least_squares


def gram(df: DataFrame, x: str, y: str | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over rows of z zᵀ and z yᵀ, z being the feature array with a 1 in front.

    Each partition gives one matrix as bytes; groups of partitions add theirs up before the driver adds the rest: what reaches it is the
    square root of the number of partitions times one matrix of features by features (+ outputs). Rows with a null array don't count.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                arrays = [np.array(c.to_pylist(), float) for c in b.columns]
                if arrays[0].shape[1] > NARROW:
                    raise InvalidParameterError(f"{arrays[0].shape[1]} features are too many for their square; see operators.wide")
                z = np.column_stack([np.ones(b.num_rows), arrays[0]])
                part = z.T @ np.column_stack([z, *arrays[1:]])
                total, n = part if total is None else total + part, n + b.num_rows
        if total is not None:
            yield pa.record_batch([[n], [len(total)], [total.tobytes()]], ["rows", "k", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, k = None, 0, 0
        for b in batches:
            for rows, k, m in zip(*(c.to_pylist() for c in b.columns)):
                part = np.frombuffer(m).reshape(k, -1)
                total, n = part if total is None else total + part, n + rows
        if total is not None:
            yield pa.record_batch([[n], [k], [total.tobytes()]], ["rows", "k", "m"])

    kind = "rows long, k long, m binary"
    columns = [x] + ([y] if y else [])
    parts = df.select(*columns).dropna().mapInArrow(partial, kind)
    groups = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = parts.repartition(groups).mapInArrow(add, kind).collect()
    if not sums:
        return np.zeros((0, 0)), np.zeros((0, 0)), 0
    k = sums[0]["k"]
    m = sum(np.frombuffer(r["m"]).reshape(k, -1) for r in sums)
    return m[:, :k], m[:, k:], sum(r["rows"] for r in sums)


def ols(df: DataFrame, x: str, y: str, penalty: float = 0.0) -> np.ndarray:
    """Coefficients of a few outputs at once, intercepts in the first row; penalty is ridge's, not on the intercept. By a tree of QRs; for
    many outputs ``wide.least_squares`` gives them as a table."""
    c = coefficient_table(least_squares(df, x, y, penalty))
    return np.column_stack([c["intercept"], np.array(c["coef"].tolist())]).T if len(c) else np.zeros((0, 0))


def predict(df: DataFrame, coef: DataFrame, x: str = "x", keys: list[str] | None = None, size: int | None = None) -> DataFrame:
    """(keys, unit, value): predictions of all units of ``coef`` (unit, coef array, intercept) for each row.

    A product in blocks of rows and of units (``size`` at most, if given), in which the intercept is the weight of a 1 behind the features.
    """
    keys = keys or []
    one = lambda c: F.concat(c, F.array(F.lit(1.0)))
    weights = coef.select("unit", F.concat(F.col("coef").cast("array<double>"), F.array(F.col("intercept").cast("double"))).alias("w"))
    rows = df.select(*keys, one(F.col(x).cast("array<double>")).alias("__x"))
    p = product(rows, keys, "__x", weights, size=size)
    return p.select(*keys, F.explode(F.arrays_zip("units", "values")).alias("__p")).select(*keys, F.col("__p.units").alias("unit"), F.col("__p.values").alias("value"))


def pca(df: DataFrame, x: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k loadings (rows) and their shares of the variance; in each the largest loading is positive."""
    a, _, n = gram(df, x)
    mean = a[0, 1:] / n
    cov = a[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values)[:k]
    loadings = vectors[:, top].T
    loadings *= np.sign(loadings[np.arange(len(top)), np.abs(loadings).argmax(axis=1)])[:, None]
    return mean, loadings, values[top] / values.sum()


def project(df: DataFrame, x: str, mean: np.ndarray, loadings: np.ndarray, out: str = "scores") -> DataFrame:
    """Scores of centred features, inside the plan: no Python worker."""
    centred = F.transform(F.col(x), lambda v, i: v.cast("double") - F.element_at(F.lit(mean.tolist()), i + 1))
    dots = [F.aggregate(F.zip_with(F.col("__c"), F.lit(row.tolist()), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) for row in loadings]
    return df.withColumn("__c", centred).withColumn(out, F.array(*dots)).drop("__c")


def ridge_grid(df: DataFrame, x: str, y: str, holdout: str, penalties: list[float]) -> pd.DataFrame:
    """Best penalty per output by squared error on the rows with ``holdout``; ties go to the first. One pass per side."""
    a, b, _ = gram(df.where(~F.col(holdout)), x, y)
    h, g, _ = gram(df.where(F.col(holdout)), x, y)
    yy = df.where(F.col(holdout)).select(F.posexplode(y).alias("j", "v")).groupBy("j").agg(F.sum(F.col("v") * F.col("v")).alias("s")).toPandas().sort_values("j")["s"].to_numpy()
    losses = []
    for p in penalties:
        r = np.eye(len(a)) * p
        r[0, 0] = 0
        w = np.linalg.solve(a + r, b)
        losses.append(yy - 2 * (w * g).sum(axis=0) + np.einsum("ij,ik,kj->j", w, h, w))
    losses = np.array(losses)
    best = losses.argmin(axis=0)
    return pd.DataFrame({"output": np.arange(b.shape[1]), "penalty": np.array(penalties)[best], "loss": losses.min(axis=0)})


def predict_by(df: DataFrame, coef: DataFrame, by: list[str], x: str = "x", keys: list[str] | None = None) -> DataFrame:
    """(by, keys, unit, value): as predict, with a read-out of its own, of any number of units, for each value of ``by``."""
    rows = df.select(*by, *(keys or []), x)
    return rows.join(coef, by).select(*by, *(keys or []), "unit", (F.col("intercept") + dot(F.col(x), F.col("coef"))).alias("value"))


def predict_groups(df: DataFrame, groups: list[tuple[str, DataFrame]], units: DataFrame, keys: list[str], size: int | None = None) -> DataFrame:
    """(keys, unit, value) over all ``units``: each group of units is predicted by a model of its own from features of its own.

    groups: (feature column, coefficients of the group's units). Units of no group are 0.
    """
    covered = reduce(DataFrame.unionByName, [c.select("unit") for _, c in groups])
    rest = units.join(covered, "unit", "left_anti").select("unit", F.array().cast("array<double>").alias("coef"), F.lit(0.0).alias("intercept"))
    parts = [predict(df, c, x, keys, size) for x, c in groups]
    return reduce(DataFrame.unionByName, [*parts, predict(df.withColumn("__none", F.array().cast("array<double>")), rest, "__none", keys, size)])


def parameter_counts(shapes: DataFrame, keys: list[str], sizes: str = "sizes") -> DataFrame:
    """(keys, params): numbers in all arrays of the given sizes; an array without sizes is one number."""
    return shapes.groupBy(*keys).agg(F.sum(F.aggregate(sizes, F.lit(1).cast("long"), lambda a, n: a * n)).alias("params"))
