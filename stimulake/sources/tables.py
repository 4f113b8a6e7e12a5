"""Tables of a data directory, and the stimulus-response views on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as trials: stim, unit, session, measured, predicted."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 50).alias("stim"),
        F.col("l_suppkey").alias("unit"),
        F.year("l_shipdate").cast("long").alias("session"),
        F.col("l_extendedprice").alias("measured"),
        F.col("l_quantity").alias("predicted"),
    )


def unit_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as units with the region of their nation as region of interest: unit, roi."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("unit"), F.col("r_name").alias("roi"))
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings in long form: stim, dim, value, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("dim", "value")).withColumns({"dim": F.col("dim").cast("long"), "value": F.col("value").cast("double")})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as they are: stim, label, x (array of 64 doubles), for work inside a row."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a recording: event_id, channel, code, second (since 2024), value."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("channel"),
        F.col("event_type").alias("code"),
        F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1_704_067_200_000_000)) / 1_000_000).cast("long").alias("second"),
        "value",
    )


#: The same views in SQL.
MEASUREMENTS = "m AS (SELECT l_partkey % 50 AS stim, l_suppkey AS unit, year(l_shipdate)::BIGINT AS session, l_extendedprice AS measured, l_quantity AS predicted FROM lineitem)"
UNIT_REGIONS = "u AS (SELECT s_suppkey AS unit, r_name AS roi FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
FEATURES = "f AS (SELECT vec_id AS stim, label::BIGINT AS label, (i - 1)::BIGINT AS dim, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings))"
RECORDING = "e AS (SELECT event_id, user_id AS channel, event_type AS code, floor((epoch_us(ts) - 1704067200000000) / 1000000)::BIGINT AS second, value FROM events)"
