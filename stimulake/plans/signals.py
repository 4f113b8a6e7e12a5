"""Queries of filtered and resampled series, fits of fields, and volumes on surfaces."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaussians, images, scalp, series, surfaces
from ..sources.tables import RECORDING, recording, table, vectors
from .responses import r6

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL, if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


#: Events binned by hour and kind.
BINNED = RECORDING + ", s AS (SELECT code AS channel, second // 3600 AS hour, sum(value) AS value FROM e GROUP BY ALL)"


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recording(spark, sf_dir).groupBy(F.col("code").alias("channel"), F.expr("second div 3600").alias("hour"))
    return e.agg(F.sum("value").alias("value"))


HALF = 33  # 3.3 / width / 2
LOW_SQL = "SELECT k, {v} * CASE WHEN k = 0 THEN 1 ELSE sin(2 * pi() * {f} * k) / (2 * pi() * {f} * k) END * (0.54 + 0.46 * cos(pi() * k / {h})) AS t FROM (SELECT unnest(range(-{h}, {h} + 1)) AS k)"


@query(
    f"WITH {BINNED}, a AS ({LOW_SQL.format(f='0.2::DOUBLE', v='0.4::DOUBLE', h=HALF)}), b AS ({LOW_SQL.format(f='0.02::DOUBLE', v='0.04::DOUBLE', h=HALF)}), "
    "w AS (SELECT a.k, a.t / (SELECT sum(t) FROM a) - b.t / (SELECT sum(t) FROM b) AS w FROM a JOIN b USING (k)) "
    "SELECT s.channel, s.hour, round(sum(w * o.value), 5) + 0.0 AS value FROM s CROSS JOIN w JOIN s o ON o.channel = s.channel AND o.hour = s.hour + w.k GROUP BY s.channel, s.hour"
)
def band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of each kind of event, from 0.02 to 0.2 cycles an hour."""
    out = series.filtered(_binned(spark, sf_dir), ["channel"], "hour", "value", series.band_taps(0.02, 0.2, 0.05), pad="zero", size=512)
    return out.withColumn("value", F.round("value", 5))


@query(
    f"WITH {BINNED}, b AS (SELECT channel, min(hour) AS low, max(hour) AS high FROM s GROUP BY channel), "
    "j AS (SELECT channel, unnest(range(ceil(low * 2 / 3.0)::BIGINT, floor(high * 2 / 3.0)::BIGINT + 1)) AS j FROM b), "
    "u AS (SELECT j.channel, j, coalesce(value, 0) AS value, coalesce(j * 1.5 - hour, 0) AS u FROM j LEFT JOIN s ON s.channel = j.channel AND hour BETWEEN floor(j * 1.5)::BIGINT - 12 AND floor(j * 1.5)::BIGINT + 13), "
    "w AS (SELECT *, greatest(least(u / 12, 1), -1) * pi() AS a FROM u) "
    "SELECT channel, j AS hour, round(sum(value * 2 / 3.0::DOUBLE * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * u * 2 / 3) / (pi() * u * 2 / 3) END * (0.35875 + 0.48829 * cos(a) + 0.14128 * cos(2 * a) + 0.01168 * cos(3 * a))), 5) + 0.0 AS value FROM w GROUP BY channel, j"
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two samples for every three hours."""
    out = series.resampled(_binned(spark, sf_dir), ["channel"], "hour", "value", 2, 3, lobes=8, pad="zero", size=512)
    return out.withColumn("value", F.round("value", 5))


@query()
def gaussian_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turned Gaussian for each map."""
    f = gaussians.fit_maps(vectors(spark, sf_dir), ["stim"], "x", 8, 8)
    return f.select("stim", F.round("residual", 4).alias("residual"), F.transform("params", lambda v: F.round(v, 3)).alias("params"))


VOLUME = "c AS (SELECT p_partkey % 8 AS i, p_partkey // 8 % 8 AS j, p_partkey // 64 AS k, p_retailprice AS value FROM part), v AS (SELECT s_suppkey AS unit, s_suppkey * 37 % 80 / 10.0::DOUBLE AS x, s_suppkey * 53 % 70 / 10.0::DOUBLE AS y, s_suppkey * 11 % 40 / 10.0::DOUBLE AS z FROM supplier)"


def _volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Prices on a grid whose last cells are missing, and a place in it for each supplier."""
    p, s = F.col("p_partkey").cast("long"), F.col("s_suppkey").cast("long")
    cells = table(spark, sf_dir, "part").select((p % 8).alias("i"), (F.floor(p / 8) % 8).alias("j"), F.floor(p / 64).alias("k"), F.col("p_retailprice").alias("value"))
    return table(spark, sf_dir, "supplier").select(s.alias("unit"), (s * 37 % 80 / 10).alias("x"), (s * 53 % 70 / 10).alias("y"), (s * 11 % 40 / 10).alias("z")), cells


@query(
    f"WITH {VOLUME}, o AS (SELECT unit, dx, dy, dz, floor(x)::BIGINT + dx AS i, floor(y)::BIGINT + dy AS j, floor(z)::BIGINT + dz AS k, abs(1 - dx - (x - floor(x))) * abs(1 - dy - (y - floor(y))) * abs(1 - dz - (z - floor(z))) AS w "
    "FROM v, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dz)), g AS (SELECT unit, sum(w * value) / sum(w) AS value FROM o JOIN c USING (i, j, k) WHERE w > 0 GROUP BY unit) "
    "SELECT unit, round(value, 6) AS value FROM v LEFT JOIN g USING (unit)"
)
def volume_to_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(surfaces.sample_volume(*_volume(spark, sf_dir), ["unit"]))


@query(f"WITH {VOLUME} SELECT unit, round(value, 6) AS value FROM v LEFT JOIN c ON i = floor(x + 0.5) AND j = floor(y + 0.5) AND k = floor(z + 0.5)")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(surfaces.sample_volume(*_volume(spark, sf_dir), ["unit"], method="nearest"))


@query()
def source_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as the potentials of 64 electrodes, evenly spread on a sphere by the golden angle."""
    n = np.arange(64)
    z, turn = 1 - (2 * n + 1) / 64, n * np.pi * (3 - 5**0.5)
    at = np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])
    c = scalp.current_source_density(vectors(spark, sf_dir), ["stim"], "x", at)
    return r6(c.select("stim", F.posexplode("values").alias("electrode", "value")))


#: The middle 6 of 8 rows and 6 columns, seen as 4 by 4: each new pixel takes old ones by a triangle of 1.5 pixels.
CROPPED = "i AS (SELECT vec_id AS stim, k // 12 AS y, k // 2 % 6 AS x, k % 2 AS channel, embedding[k % 64 + 1]::DOUBLE AS value FROM embeddings, (SELECT unnest(range(0, 96)) AS k)), t AS (SELECT o, s, greatest(1 - abs(s + 0.5 - (o + 0.5) * 1.5) / 1.5::DOUBLE, 0) AS w FROM (SELECT unnest(range(0, 4)) AS o), (SELECT unnest(range(0, 6)) AS s)), w AS (SELECT o, s, w / sum(w) OVER (PARTITION BY o) AS w FROM t)"


@query(f"WITH {CROPPED} SELECT stim, channel, a.o AS y, b.o AS x, round((sum(value * a.w * b.w) / 2 - 0.1 * (channel + 1)) / (channel + 1), 6) AS value FROM i JOIN w a ON a.s = i.y - 1 JOIN w b ON b.s = i.x GROUP BY stim, channel, a.o, b.o")
def image_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 8 by 6 pixels and two channels out of each vector, their middle square resized and scaled."""
    v = vectors(spark, sf_dir)
    own = v.select("stim", F.lit(8).alias("h"), F.lit(6).alias("w"), F.concat("x", F.slice("x", 1, 32)).alias("image"))
    p = images.prepared(own, ["stim"], "image", "h", "w", 2, 4, divide=2.0, mean=(0.1, 0.2), scale=(1.0, 2.0))
    out = p.select("stim", F.posexplode("values").alias("k", "value"))
    return r6(out.select("stim", F.floor(F.col("k") / 16).alias("channel"), F.floor(F.col("k") / 4 % 4).alias("y"), (F.col("k") % 4).alias("x"), "value"))
