"""Running moments of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Number, mean and population variance per key and window of a stream or a table; rows later than ``late`` are left out of a stream."""
    v = F.col(value)
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    w = rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"))
    return w.select(F.col("w.start").alias("start"), key, "n", "mean", "var")
