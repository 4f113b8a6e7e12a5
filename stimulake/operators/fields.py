"""Receptive fields and resampling: small grids joined with feature maps and summed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import gaussian


def axis(n: int, low: float, high: float) -> list[float]:
    """n evenly spaced values, both ends included."""
    return [low + (high - low) * i / (n - 1) for i in range(n)] if n > 1 else [low]


#: What the reference's logarithmic axes add to both ends, so that they may begin at 0: a fixed value.
TINY = 1e-12


def log_axis(n: int, low: float, high: float) -> list[float]:
    """n values with even ratios, both ends included."""
    return [math.exp(x) for x in axis(n, math.log(low + TINY), math.log(high + TINY))]


def spaced(n: int, center: float, width: float, right_bound: bool = False) -> list[float]:
    """n evenly spaced values: the middles of n cells around a centre, or, right-bound, from the centre to centre + width; one alone is the centre."""
    if n <= 1:
        return [center]
    if right_bound:
        return [center + width * i / (n - 1) for i in range(n)]
    return [center - width / 2 + width * (i + 0.5) / n for i in range(n)]


def axis_of(n: Column, low: Column, high: Column, log: bool = False) -> Column:
    """As axis and log_axis, from columns: an array for each row."""
    a, b = (F.log(low + TINY), F.log(high + TINY)) if log else (low, high)
    value = lambda i: a + (b - a) * i / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: F.exp(value(i)) if log else value(i))


def spaced_of(n: Column, center: Column, width: Column, right_bound: bool = False) -> Column:
    """As spaced, from columns."""
    value = lambda i: center + width * i / F.greatest(n - 1, F.lit(1)) if right_bound else center - width / 2 + width * (i + 0.5) / n
    return F.when(n <= 1, F.array(center.cast("double"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), value))


def rf_grids(settings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, model_id, x, y, sigma) for each row (keys, n, n_sigma, aperture, low, high): every pair of n positions a side with every one of
    n_sigma widths from low to high; x varies slowest, sigma fastest. One position is the centre, one width the low one."""
    n, m, k = F.col("n").cast("long"), F.col("n_sigma").cast("long"), F.col("model_id")
    s = settings.withColumn("model_id", F.explode(F.sequence(F.lit(0).cast("long"), n * n * m - 1)))
    place = lambda i: F.when(n > 1, i * (F.col("aperture") / F.greatest(n - 1, F.lit(1))) - F.col("aperture") / 2).otherwise(F.lit(0.0))
    ratio = F.log(F.col("high") / F.col("low")) / F.greatest(m - 1, F.lit(1))
    return s.select(*keys, "model_id", place(F.floor(k / (m * n))).alias("x"), place(F.floor(k / m) % n).alias("y"), (F.col("low") * F.exp(k % m * ratio)).alias("sigma"))


def rf_grid(spark: SparkSession, n: int, n_sigma: int, aperture: float, sigmas: tuple[float, float]) -> DataFrame:
    """rf_grids for one setting."""
    return rf_grids(spark.createDataFrame([(n, n_sigma, float(aperture), float(sigmas[0]), float(sigmas[1]))], "n long, n_sigma long, aperture double, low double, high double"), [])


def rf_pyramids(settings: DataFrame, keys: list[str], aperture: float, spacing: float) -> DataFrame:
    """(keys, sigma, i, j, x, y): for each row's width a square grid, both ends included, whose step grows with it; j runs along x, fastest."""
    s = settings.select(*keys, "sigma", F.ceil(F.lit(float(aperture)) / (F.col("sigma") * spacing)).cast("int").alias("n"))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    place = lambda k: F.col(k) * aperture / F.greatest(F.col("n") - 1, F.lit(1)) - aperture / 2
    return s.select(*keys, "sigma", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), place("j").alias("x"), place("i").alias("y"))


def rf_pyramid(spark: SparkSession, sigmas: list[float], aperture: float, spacing: float) -> DataFrame:
    return rf_pyramids(spark.createDataFrame([(float(x),) for x in sigmas], "sigma double"), [], aperture, spacing)


def pixels(spark: SparkSession, n: int) -> DataFrame:
    """(x, y) of an n by n map."""
    return spark.range(n * n).select(F.floor(F.col("id") / n).alias("x"), (F.col("id") % n).alias("y"))


def field_pixels(spark: SparkSession, n: int, size: float, rfs: list[tuple[float, float, float]]) -> DataFrame:
    """(rf, row, col, px, py, x0, y0, sigma): fields given as (x, y, sigma) over the pixels of a map that is ``size`` wide and centred; y points up."""
    d = size / n
    listed = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("rf"), *[F.lit(float(v)).alias(c) for v, c in zip(r, ("x0", "y0", "sigma"))]) for i, r in enumerate(rfs)]))
    p = pixels(spark, n).withColumnsRenamed({"x": "row", "y": "col"}).withColumn("r", listed)
    return p.select("r.rf", "row", "col", (F.col("col") * d + (d - size) / 2).alias("px"), (-(F.col("row") * d + (d - size) / 2)).alias("py"), "r.x0", "r.y0", "r.sigma")


def gaussian_stack(spark: SparkSession, n: int, rfs: list[tuple[float, float, float]], size: float | None = None) -> DataFrame:
    """(rf, row, col, w): Gaussian fields on the pixels of a map; one narrower than half a pixel is scaled to sum to 1."""
    size = float(n) if size is None else size
    f = field_pixels(spark, n, size, rfs).withColumn("w", gaussian(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("sigma"), size / n))
    whole = F.sum("w").over(Window.partitionBy("rf"))
    return f.select("rf", "row", "col", F.when(F.col("sigma") < size / n / 2, F.try_divide(F.col("w"), whole)).otherwise(F.col("w")).alias("w"))


def gaussian_mass_stack(spark: SparkSession, n: int, rfs: list[tuple[float, float, float]], size: float | None = None) -> DataFrame:
    """(rf, row, col, w): as gaussian_stack, but a field narrower than a pixel has each pixel's mass by the error function, and one
    without width is 0. Spark has no error function, so that is an Arrow UDF over the pixels of those fields."""
    size = float(n) if size is None else size
    d = size / n

    @F.pandas_udf("double")
    def mass(x: pd.Series, y: pd.Series, x0: pd.Series, y0: pd.Series, sigma: pd.Series) -> pd.Series:
        erf = np.vectorize(math.erf, otypes=[float])
        s = np.maximum(sigma.to_numpy(), 1e-12) * math.sqrt(2)
        side = lambda v, c: (erf((v - c + d / 2).to_numpy() / s) - erf((v - c - d / 2).to_numpy() / s)) / 2
        return pd.Series(side(x, x0) * side(y, y0))

    f = field_pixels(spark, n, size, rfs)
    place = [F.col(c) for c in ("px", "py", "x0", "y0", "sigma")]
    narrow = f.where((F.col("sigma") > 0) & (F.col("sigma") < d)).withColumn("w", mass(*place))
    wide = f.where((F.col("sigma") <= 0) | (F.col("sigma") >= d)).withColumn("w", F.when(F.col("sigma") <= 0, 0.0).otherwise(gaussian(*place, d)))
    return narrow.unionByName(wide).select("rf", "row", "col", "w")


def weight_arrays(weights: DataFrame) -> list[list[float]]:
    """The maps of a stack as arrays, row by row: fields times pixels of one model, which fit the driver."""
    rows = weights.groupBy("rf").agg(F.array_sort(F.collect_list(F.struct("row", "col", "w"))).alias("p")).orderBy("rf").collect()
    return [[p["w"] for p in r["p"]] for r in rows]


def pool(maps: DataFrame, weights: DataFrame, keys: list[str], out: str = "pooled") -> DataFrame:
    """Sum of map times weight over pixels, per key. The weights are one small map: Spark broadcasts them by their size."""
    return maps.join(weights, ["x", "y"]).groupBy(*keys).agg(F.sum(F.col("value") * F.col("w")).alias(out))


def roughness(values: Column, side: int, power: float) -> Column:
    """Sum of the steps between neighbours along both axes of a square map, given row by row, each to a power; inside each row."""
    at = F.sequence(F.lit(0), F.lit(side * side - 1))
    step = lambda i, far: F.pow(F.abs(F.get(values, i + far) - F.get(values, i)), F.lit(power))
    down = F.transform(F.filter(at, lambda i: i < side * (side - 1)), lambda i: step(i, side))
    across = F.transform(F.filter(at, lambda i: i % side < side - 1), lambda i: step(i, 1))
    return F.aggregate(F.concat(down, across), F.lit(0.0), lambda s, v: s + v)


def softmax(values: list[float]) -> list[float]:
    e = np.exp(np.array(values) - max(values))
    return (e / e.sum()).tolist()


def overlaps(old: int, new: int) -> np.ndarray:
    """Length of each old cell inside each new one, both axes having the same extent, in old cells."""
    edges = np.arange(new + 1) * (old / new)
    k = np.arange(old)
    return np.clip(np.minimum(edges[1:, None], k + 1) - np.maximum(edges[:-1, None], k), 0, None)


def shared_field(field: list[float], rez: int, side: int) -> list[float]:
    """The weights on a map of ``side`` pixels of a field given on ``rez`` pixels a side, row by row.

    A finer map is averaged to the field's grid, a coarser one gets the field's sums, and a single pixel passes with weight 1.
    """
    if side == 1:
        return [1.0]
    g = np.array(field).reshape(rez, rez)
    if side > rez:
        m = overlaps(side, rez)
        m = m / m.sum(axis=1, keepdims=True)
        return (m.T @ g @ m).ravel().tolist()
    m = overlaps(rez, side)
    return (m @ g @ m.T).ravel().tolist()


def area_matrix(spark: SparkSession, old: int, new: int, normalise: bool = True) -> DataFrame:
    """(src, dst, w): overlap of each old cell with each new one; normalised, a new cell's weights sum to 1."""
    ratio = old / new
    d = spark.range(new).withColumnRenamed("id", "dst").withColumn("src", F.explode(F.sequence(F.floor(F.col("dst") * ratio), F.least(F.ceil((F.col("dst") + 1) * ratio), F.lit(old)) - 1)))
    w = F.least(F.col("src") + 1, (F.col("dst") + 1) * ratio) - F.greatest(F.col("src").cast("double"), F.col("dst") * ratio)
    return d.select("src", "dst", (w / ratio if normalise else w).alias("w")).where("w > 1e-12")


def linear_matrix(spark: SparkSession, old: int, new: int, normalise: bool = True) -> DataFrame:
    """(src, dst, w): two neighbours for each new point between the first old point and the last; normalised, an old point's weights sum to 1."""
    at = F.col("id") * (old - 1) / (new - 1)
    low = F.least(F.floor(at), F.lit(old - 2))
    pair = F.array(F.struct(low.alias("src"), (1 - (at - low)).alias("w")), F.struct((low + 1).alias("src"), (at - low).alias("w")))
    m = spark.range(new).select(F.col("id").alias("dst"), F.explode(pair).alias("p")).select("p.src", "dst", "p.w")
    return m.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))) if normalise else m


def sampling_matrix(spark: SparkSession, old: int, new: int, preserve_norm: bool = True) -> DataFrame:
    """Up or down as the sizes say. Preserving the norm, what an old cell holds is dealt out in full; else new cells are means (down) or
    plain interpolation (up)."""
    return linear_matrix(spark, old, new, preserve_norm) if new > old else area_matrix(spark, old, new, not preserve_norm)


def resample(maps: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """A map resampled along both axes by the same one-dimensional matrix."""
    along = lambda m, a: m.join(matrix.select(F.col("src").alias(a), "dst", "w"), a).withColumn("value", F.col("value") * F.col("w")).drop(a, "w").withColumnRenamed("dst", a).groupBy(*keys, "x", "y").agg(F.sum("value").alias("value"))
    return along(along(maps, "x"), "y")
