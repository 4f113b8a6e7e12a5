"""Time series: onsets, epochs and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import around


def onsets(df: DataFrame, keys: list[str], order: list[str], code: str, size: int | None = None) -> DataFrame:
    """Rows where a non-null code begins: it differs from the code before it in the same series.

    With ``size`` a series is cut into stretches of so many steps of its first order column, a number, so a recording of few channels isn't few
    tasks' work; each stretch gets the last code of the one before it, one row a stretch.
    """
    if size is None:
        before = F.lag(code).over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("__before", before).where(F.col(code).isNotNull() & ~F.col(code).eqNullSafe(F.col("__before"))).drop("__before")
    cut = df.withColumn("__block", F.floor(F.col(order[0]) / size))
    own = Window.partitionBy(*keys, "__block").orderBy(*order)
    cut = cut.withColumns({"__before": F.lag(code).over(own), "__i": F.row_number().over(own)})
    names = [f"__key{i}" for i in range(len(keys))]
    lasts = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__block").alias("__b")).agg(F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(code).alias("code"))).alias("l"))
    lasts = lasts.select(*names, "__b", F.lag("l.code").over(Window.partitionBy(*names).orderBy("__b")).alias("__last"))
    same = (F.col("__i") == 1) & F.col("__block").eqNullSafe(F.col("__b"))
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    joined = cut.join(lasts, same, "left")
    before = F.when(F.col("__i") == 1, F.col("__last")).otherwise(F.col("__before"))
    return joined.where(F.col(code).isNotNull() & ~F.col(code).eqNullSafe(before)).select(*df.columns)


def epochs(triggers: DataFrame, samples: DataFrame, low: int, high: int, keys: list[str]) -> DataFrame:
    return around(triggers, samples, low, high, keys)


def baseline(df: DataFrame, keys: list[str], value: str, before: Column, mode: str = "mean", out: str = "corrected") -> DataFrame:
    """Subtracts the mean of the samples where ``before`` holds, and with ``zscore`` divides by their population deviation."""
    w = Window.partitionBy(*keys)
    base = F.when(before, F.col(value))
    centred = F.col(value) - F.avg(base).over(w)
    return df.withColumn(out, F.try_divide(centred, F.stddev_pop(base).over(w)) if mode == "zscore" else centred)
