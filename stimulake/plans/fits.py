"""Queries of models with many features, many outputs or many candidates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, linalg, wide
from ..operators.written import written
from ..sources.tables import FEATURES, table, vectors
from .responses import r6

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL, if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query()
def wide_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three components of all 4,096 products of two features, standardised, without a matrix of features by features."""
    v = vectors(spark, sf_dir)
    x = v.select("stim", F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b))).alias("x"))
    c = wide.components(x, ["stim"], "x", 3, standardise=True)
    return r6(c.scores(x, "x", ["stim"]).select("stim", F.posexplode("scores").alias("component", "score")))


@query()
def least_squares_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """44 outputs fitted on 20 features of the rows that aren't held out, and predicted for all rows."""
    xy = vectors(spark, sf_dir).select("stim", F.slice("x", 1, 20).alias("x"), F.slice("x", 21, 44).alias("y"))
    coef = written(wide.least_squares(xy.where("stim % 5 <> 0"), "x", "y"), "readout")
    return r6(linalg.predict(xy, coef, keys=["stim"]))


PENALTIES = [0.1, 1.0, 100.0]
#: A candidate field for each nation, a response for each pixel of the diagonal (with half of the one across), one feature, a ridge in closed form.
FIELD_FITS = f"""WITH {FEATURES}, c AS (SELECT n_nationkey::BIGINT AS model, (n_nationkey % 5 - 2) * 1.5::DOUBLE AS x0, (n_nationkey // 5 - 2) * 1.5::DOUBLE AS y0, 1 + 0.5::DOUBLE * n_regionkey AS s FROM nation),
w AS (SELECT model, k AS dim, exp(-(power(k % 8 - 3.5 - x0, 2) + power(3.5 - k // 8 - y0, 2)) / (2 * s * s)) / ({2 * math.pi}::DOUBLE * s * s) AS w FROM c, (SELECT unnest(range(0, 64)) AS k)),
p AS (SELECT stim, model, sum(value * w) AS phi FROM f JOIN w USING (dim) GROUP BY ALL),
z AS (SELECT stim, model, (phi - avg(phi) OVER (PARTITION BY model)) / (stddev_pop(phi) OVER (PARTITION BY model) + 1e-6) AS z FROM p),
y AS (SELECT stim, dim // 9 AS unit, value + 0.5 * (SELECT g.value FROM f g WHERE g.stim = f.stim AND g.dim = f.dim // 9 * 7 + 7) AS y FROM f WHERE dim % 9 = 0),
t AS (SELECT model, unit, count(*) AS n, sum(z) AS sz, sum(z * z) AS zz, sum(y) AS sy, sum(z * y) AS zy FROM z JOIN y USING (stim) WHERE stim % 5 <> 0 GROUP BY ALL),
l AS (SELECT * FROM (VALUES (0, 0.1::DOUBLE), (1, 1), (2, 100)) AS l(i, penalty)),
b AS (SELECT model, unit, i, penalty, ((zz + penalty) * sy - sz * zy) / ((n + penalty) * (zz + penalty) - sz * sz) AS b0, ((n + penalty) * zy - sz * sy) / ((n + penalty) * (zz + penalty) - sz * sz) AS b1 FROM t, l),
r AS (SELECT model, unit, i, penalty, b0, b1, sum(power(y - b0 - b1 * z, 2)) AS loss FROM b JOIN z USING (model) JOIN y USING (stim, unit) WHERE stim % 5 = 0 GROUP BY ALL),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY unit ORDER BY loss, model, i) = 1) """


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda k: F.element_at("x", k + 1)
    y = F.array(*[pixel(9 * u) + 0.5 * pixel(7 * u + 7) for u in range(8)])
    return vectors(spark, sf_dir).select("stim", "x", y.alias("y"), (F.col("stim") % 5 == 0).alias("held"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(k.alias("model"), ((k % 5 - 2) * 1.5).alias("x"), ((F.floor(k / 5) - 2) * 1.5).alias("y"), (1 + 0.5 * F.col("n_regionkey")).alias("sigma"))


@query(FIELD_FITS + "SELECT unit, model, penalty, round(loss, 6) AS loss FROM best")
def field_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each response's best candidate field and penalty."""
    weights = candidates.field_weights(spark, _fields(spark, sf_dir), [8], 8.0)
    return r6(candidates.search(_responses(spark, sf_dir), "x", "y", "held", weights, [(1, 8)], PENALTIES).select("unit", "model", "penalty", "loss"))


@query(FIELD_FITS + "SELECT stim, unit, round(b0 + b1 * z, 6) + 0.0 AS value FROM best JOIN z USING (model)")
def field_search_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each response from its own candidate, penalty and z-score."""
    d, weights = _responses(spark, sf_dir), candidates.field_weights(spark, _fields(spark, sf_dir), [8], 8.0)
    models = written(candidates.search(d, "x", "y", "held", weights, [(1, 8)], PENALTIES), "fields")
    return r6(candidates.predict(d, ["stim"], "x", models, weights, [(1, 8)]))


@query()
def field_search_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over two layers, of two channels of 5 by 5 and three of 2 by 2 pixels, with the weights of the best."""
    weights = candidates.field_weights(spark, _fields(spark, sf_dir), [5, 2], 8.0)
    found = candidates.search(_responses(spark, sf_dir), "x", "y", "held", weights, [(2, 5), (3, 2)], PENALTIES)
    return r6(found.select("unit", "model", "penalty", "loss", "intercept", F.posexplode("coef").alias("feature", "coef")))
