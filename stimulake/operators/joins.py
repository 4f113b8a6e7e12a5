"""Joins with the key rules of stimulus-response tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameterError


def zip_strict(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Inner join on keys that must be the same set on both sides."""
    if check:
        marked = left.select(*keys).distinct().withColumn("__l", F.lit(1)).join(right.select(*keys).distinct().withColumn("__r", F.lit(1)), keys, "full_outer")
        odd = marked.where("__l IS NULL OR __r IS NULL").select(*keys).take(5)
        if odd:
            raise InvalidParameterError(f"keys on one side only, such as {[tuple(x) for x in odd]}")
    return left.join(right, keys)


def zip_all(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: zip_strict(a, b, keys), tables)


def around(events: DataFrame, samples: DataFrame, low: int, high: int, keys: list[str], at: str = "at") -> DataFrame:
    """Samples from low to high steps around each event, both ends included: an equi-join on (keys, step).

    Both tables have an integer column ``at``; the result has the event's columns, the sample's others and ``offset``. Each event
    is laid out over its steps, so the join is hashed or sorted like any other instead of comparing ranges.
    """
    laid = events.withColumn("offset", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("__step", F.col(at) + F.col("offset"))
    return laid.join(samples.withColumnRenamed(at, "__step"), [*keys, "__step"]).drop("__step")
