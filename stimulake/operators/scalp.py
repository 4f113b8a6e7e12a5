"""Current source density: the Laplacian of a spherical spline through the potentials at electrodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError
from .blocks import batches_of, doubles

#: Electrodes of one cap at most: their matrix is made on the driver.
ELECTRODES = 2048


def csd_matrix(positions: np.ndarray, radius: float = 1.0, regular: float = 1e-5, stiffness: int = 4, terms: int = 50) -> np.ndarray:
    """What the potentials of all electrodes are multiplied with: electrodes by electrodes, for positions (x, y, z) around the centre.

    The spline of order ``stiffness`` is fitted with ``regular`` on its diagonal and coefficients that sum to 0, over the potentials' own
    mean; its negative Laplacian, of unit conductivity, follows from the same Legendre series, term n times n(n + 1).
    """
    p = np.asarray(positions, float)
    length = np.linalg.norm(p, axis=1) if p.ndim == 2 and p.shape[1:] == (3,) else np.zeros(1)
    if not len(p) or len(p) > ELECTRODES or not (np.isfinite(length) & (length > 0)).all():
        raise InvalidParameterError(f"1 to {ELECTRODES} electrodes with three finite coordinates, none at the centre, are needed")
    p = p / length[:, None]
    n = np.arange(1, terms + 1)
    angle = np.clip(p @ p.T, -1, 1)
    series = lambda power: np.polynomial.legendre.legval(angle, np.append(0, (2 * n + 1) / (n * (n + 1.0)) ** power)) / (4 * np.pi)
    values, vectors = np.linalg.eigh(series(stiffness))  # symmetric, and no less than 0 but for rounding
    inverse = vectors / (np.maximum(values, 0) + regular) @ vectors.T
    ones = np.ones((len(p), 1))
    share = inverse @ ones
    coefficients = inverse - share @ share.T / share.sum()
    return series(stiffness - 1) @ coefficients @ (np.eye(len(p)) - ones @ ones.T / len(p)) / radius**2


def current_source_density(df: DataFrame, keys: list[str], x: str, positions: np.ndarray, **settings) -> DataFrame:
    """(keys, values): each row's potentials, an array in the order of the electrodes, as current source density.

    A row's own product with one small matrix: time points and trials stay where they are. Rows with a null array are left out, a null
    potential makes its row's values null.
    """
    matrix = csd_matrix(positions, **settings).T
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = doubles(b.column(b.num_columns - 1), len(matrix)) @ matrix
                yield pa.record_batch([*b.columns[:-1], batches_of(v)], [*keys, "values"])

    out = df.select(*keys, x).where(F.col(x).isNotNull()).mapInArrow(f, f"{kinds}{', ' if kinds else ''}values array<double>")
    return out.withColumn("values", F.transform("values", lambda v: F.nanvl(v, F.lit(None).cast("double"))))
