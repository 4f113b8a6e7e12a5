"""Queries over nested records, seeded draws, and models of groups of units."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import linalg, records
from ..sources.tables import FEATURES, table, vectors
from .responses import r6

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL, if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


LEAVES = "l AS (SELECT s_suppkey AS id, unnest([{'path': 'name', 'value': to_json(s_name)::VARCHAR}, {'path': 'at.nation', 'value': s_nationkey::VARCHAR}, {'path': 'at.codes@0', 'value': s_suppkey::VARCHAR}, {'path': 'at.codes@1.code', 'value': (s_nationkey + 1)::VARCHAR}]) AS p FROM supplier)"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as JSON objects with objects and lists inside."""
    codes = F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit('{"code":'), (F.col("s_nationkey") + 1).cast("string"), F.lit("}")))
    inner = F.concat(F.lit('{"nation":'), F.col("s_nationkey").cast("string"), F.lit(',"codes":['), F.array_join(codes, ","), F.lit("]}"))
    name = F.regexp_extract(F.to_json(F.struct("s_name")), r'^\{"s_name":(.*)\}$', 1)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit('{"name":'), name, F.lit(',"at":'), inner, F.lit("}")).alias("record"))


@query(f"WITH {LEAVES} SELECT id, p.path AS path, p.value AS value FROM l")
def flatten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.flatten(_nested(spark, sf_dir), "id", "record")


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey::BIGINT AS nation, s_suppkey::BIGINT AS first_code, (s_nationkey + 1)::BIGINT AS second_code FROM supplier")
def rebuild_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records taken apart and put together again, then read by path."""
    r = records.rebuild(records.flatten(_nested(spark, sf_dir), "id", "record"), "id")
    get = lambda path: F.get_json_object("record", path)
    return r.select("id", get("$.name").alias("name"), *[get(p).cast("long").alias(c) for p, c in (("$.at.nation", "nation"), ("$.at.codes[0]", "first_code"), ("$.at.codes[1].code", "second_code"))])


def _uniform(key: str, seed: int) -> str:
    return f"((('0x' || substr(md5({key} || ':{seed}'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


@query(f"WITH {FEATURES} SELECT dim, round(avg(value), 6) AS mean FROM f WHERE {_uniform('dim', 7)} >= 0.25 GROUP BY dim")
def feature_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the features that a random mask keeps, about three quarters."""
    kept = vectors(spark, sf_dir).select(F.posexplode("x").alias("dim", "value")).where(C.pruning_mask(F.col("dim"), 0.25, 7))
    return r6(kept.groupBy("dim").agg(F.avg("value").alias("mean")))


POINT = "(vec_id || ',' || dim)"
NORMAL = f"sqrt(-2 * ln({_uniform(POINT, 6)})) * cos({2 * math.pi} * {_uniform(POINT, 7)})"


@query(f"WITH d AS (SELECT vec_id, dim, 2 * {_uniform(POINT, 2)} - 1 AS cube, {NORMAL} AS normal FROM embeddings, (SELECT unnest(range(0, 3)) AS dim)) SELECT vec_id AS stim, dim, round(cube, 6) AS cube, round(normal, 6) AS normal, round(normal / sqrt(sum(normal * normal) OVER (PARTITION BY vec_id)), 6) AS sphere FROM d")
def random_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per stimulus, uniform in a cube, normal, and uniform on a sphere; drawn from keys, so any engine repeats them."""
    key = lambda i: F.concat_ws(",", "vec_id", F.lit(str(i)))
    p = table(spark, sf_dir, "embeddings").select("vec_id", *[F.array(*[f(key(i)) for i in range(3)]).alias(n) for n, f in (("cube", lambda k: 2 * C.hashed_uniform(k, 2) - 1), ("normal", lambda k: C.hashed_normal(k, 3)))])
    p = p.withColumn("sphere", C.unit_norm(F.col("normal"))).select(F.col("vec_id").alias("stim"), F.posexplode(F.arrays_zip("cube", "normal", "sphere")).alias("dim", "p"))
    return r6(p.select("stim", "dim", "p.cube", "p.normal", "p.sphere"))


@query(f"WITH {FEATURES} SELECT stim, u AS unit, round(CASE WHEN u >= 8 THEN 0 ELSE 0.1 * u + sum(CASE WHEN dim // 16 = u % 4 THEN value / (1 + u % 4) * sin((dim % 16 + 1) * (u + 1)) END) END, 6) AS value FROM f, (SELECT unnest(range(0, 10)) AS u) GROUP BY stim, u")
def group_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per group of units, each with features of its own, over one axis of units; two units are in no group."""
    v = vectors(spark, sf_dir)
    groups = []
    u = F.col("id")
    for g in range(4):
        v = v.withColumn(f"x{g}", F.zip_with(F.slice("x", 16 * g + 1, 16), F.lit([1.0 + g] * 16), lambda a, s: a / s))
        coef = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda d: F.sin(d * (F.col("id") + 1)))
        groups.append((f"x{g}", spark.range(8).where(u % 4 == g).select(u.alias("unit"), coef.alias("coef"), (u * 0.1).alias("intercept"))))
    return r6(linalg.predict_groups(v, groups, spark.range(10).toDF("unit"), ["stim"], size=4))


@query(f"WITH {FEATURES} SELECT label AS subject, stim, u AS unit, round(0.1 * u + sum(value * sin((dim + 1) * (u + 1 + label))), 6) AS value FROM f, (SELECT unnest(range(0, 10)) AS u) WHERE u <= label GROUP BY label, stim, u")
def joint_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared features, and a read-out per subject over that subject's own stimuli and number of units."""
    heads = spark.range(10).select(F.col("id").alias("subject"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("unit"))
    coef = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: F.sin(d * (F.col("unit") + 1 + F.col("subject"))))
    heads = heads.withColumns({"coef": coef, "intercept": F.col("unit") * 0.1})
    return r6(linalg.predict_by(vectors(spark, sf_dir).withColumnRenamed("label", "subject"), heads, ["subject"], keys=["stim"]))


@query("WITH n AS (SELECT s_nationkey::BIGINT AS subject, count(*) AS units FROM supplier GROUP BY s_nationkey), p AS (SELECT subject, units, units * 64 + units * 64 + units AS params FROM n) SELECT subject, params, units, ((params + 1280) // units)::BIGINT AS per_unit FROM p")
def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of each subject's read-out (weights, fields of 8 by 8, intercepts), and per unit with those of the shared model."""
    n = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("subject")).agg(F.count("*").alias("units"))
    sizes = F.array(F.array("units", F.lit(64).cast("long")), F.array("units", F.lit(8).cast("long"), F.lit(8).cast("long")), F.array("units"))
    counts = linalg.parameter_counts(n.select("subject", "units", F.explode(sizes).alias("sizes")), ["subject", "units"])
    shared = 64 * 20
    return counts.select("subject", "params", "units", F.expr(f"(params + {shared}) div units").alias("per_unit"))
