"""From volumes to surfaces: each vertex takes the cells around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError

AXES = ("x", "y", "z")
CELL = ("i", "j", "k")


def sample_volume(vertices: DataFrame, cells: DataFrame, keys: list[str], value: str = "value", method: str = "linear") -> DataFrame:
    """(keys, value): a volume (i, j, k, value), which may be sparse, at vertices (keys, x, y, z) in cell coordinates.

    ``nearest`` takes the cell at the rounded place, halves up; ``linear`` the eight cells around, by their nearness, over those that exist.
    Vertices are laid out over their cells, an equi-join finds the values, and weights are summed map-side by vertex. A vertex without
    cells, or with a null coordinate, is null; null values count as missing cells. Repeated keys are one vertex each time they are the
    same point. Cells must be unique.
    """
    if method not in ("linear", "nearest"):
        raise InvalidParameterError("method must be linear or nearest")
    points = vertices.select(*keys, *[F.col(a).cast("double").alias(a) for a in AXES]).distinct()
    if method == "nearest":
        corners = F.array(F.struct(*[F.floor(F.col(a) + 0.5).alias(c) for a, c in zip(AXES, CELL)], F.lit(1.0).alias("w")))
    else:
        low = [F.floor(a) for a in AXES]
        share = [F.col(a) - b for a, b in zip(AXES, low)]
        sides = [[(n >> axis) & 1 for axis in range(3)] for n in range(8)]
        weight = lambda side: reduce(lambda p, q: p * q, [s if up else 1 - s for s, up in zip(share, side)])
        corners = F.array(*[F.struct(*[(b + up).alias(c) for b, up, c in zip(low, side, CELL)], weight(side).alias("w")) for side in sides])
    laid = points.withColumn("__corner", F.explode(corners)).select(*keys, *AXES, "__corner.*").where("w > 0")
    found = laid.join(cells.select(*[F.col(c).cast("long").alias(c) for c in CELL], F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL"), list(CELL))
    names = [f"__key{n}" for n in range(len(keys) + 3)]
    own = [*keys, *AXES]
    sums = found.groupBy(*[F.col(c).alias(n) for c, n in zip(own, names)]).agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias(value))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(own, names)])
    return points.join(sums, same, "left").select(*keys, value)
