"""Aggregations and window statistics of trials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, explained_variance, finite_or_zero, noise_ceiling


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where either side is constant, where the built-in raises."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def zscore(df: DataFrame, value: str, keys: list[str], out: str = "z", fill: float | None = 0.0) -> DataFrame:
    """Population z-score inside each group; a constant group and missing values give ``fill``.

    The moments are summed map-side and joined back, so trials aren't shuffled or sorted by group as a window would: the moments are
    one row a group, which Spark broadcasts if they are small, and a group with a large share of all trials is no hot task.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    moments = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))
    joined = df.join(moments, same)
    return joined.withColumn(out, z if fill is None else F.coalesce(finite_or_zero(z), F.lit(fill))).drop(*names, "__mean", "__sd")


def weighted_error(df: DataFrame, keys: list[str], measured: str, predicted: str, low: float = 0.1) -> DataFrame:
    """Squared error and weight per unit: the weight is the squared correlation, with 1e-6 below the fraction, between low and 1."""
    x, y = F.col(measured), F.col(predicted)
    g = df.groupBy(*keys).agg(F.sum((y - x) * (y - x)).alias("error"), F.covar_pop(x, y).alias("c"), (F.var_pop(x) * F.var_pop(y)).alias("v"))
    return g.select(*keys, "error", F.greatest(F.least(F.col("c") * F.col("c") / (F.col("v") + 1e-6), F.lit(1.0)), F.lit(low)).alias("weight"))


def repeat_mean(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean over repeats with their number."""
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def signal_to_noise(trials: DataFrame, value: str) -> DataFrame:
    """Noise-ceiling signal-to-noise ratio per unit from stimuli with two repeats or more: unit, ncsnr."""
    per_stim = trials.groupBy("unit", "stim").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).where("n >= 2")
    spread = F.greatest(F.var_samp("mean") - F.avg(F.col("var") / F.col("n")), F.lit(0.0))
    return per_stim.groupBy("unit").agg(F.sqrt(F.try_divide(spread, F.avg("var"))).alias("ncsnr"))


def encoding_accuracy(trials: DataFrame, session: str = "session", measured: str = "measured", predicted: str = "predicted", repeats: int = 3) -> DataFrame:
    """Noise-normalised encoding accuracy per unit: r, r2, noise_ceiling, explained_variance.

    Responses are z-scored per (session, unit), averaged over repeats, correlated with the predictions over stimuli; negative r
    counts as 0. Only partial sums are shuffled: moments by (session, unit), then means by (unit, stim), then sums by unit.
    """
    z = zscore(trials, measured, [session, "unit"])
    means = z.groupBy("unit", "stim").agg(F.avg("z").alias("z"), F.avg(predicted).alias("p"), F.count("z").alias("n"), F.var_samp("z").alias("var"))
    many = F.col("n") >= 2
    spread = F.greatest(F.var_samp(F.when(many, F.col("z"))) - F.avg(F.when(many, F.col("var") / F.col("n"))), F.lit(0.0))
    per_unit = means.groupBy("unit").agg(correlation(F.col("z"), F.col("p")).alias("r"), F.sqrt(F.try_divide(spread, F.avg(F.when(many, F.col("var"))))).alias("ncsnr"))
    r = clip(F.col("r"), low=0.0)
    return per_unit.select("unit", "r", (r * r).alias("r2"), noise_ceiling(F.col("ncsnr"), repeats).alias("noise_ceiling")).withColumn("explained_variance", explained_variance(F.col("r2"), F.col("noise_ceiling")))
