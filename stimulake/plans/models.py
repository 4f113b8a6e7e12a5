"""Queries over features, maps and recordings: geometry, epochs, linear models and tuning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import epochs, fields, linalg, splits, stats
from ..sources.tables import FEATURES, MEASUREMENTS, RECORDING, features, measurements, recording, table, vectors
from .responses import R_SQL, r6

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL, if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


MAPS = FEATURES + ", mp AS (SELECT stim, dim // 8 AS x, dim % 8 AS y, value FROM f)"
PI2 = 2 * math.pi


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as 8 by 8 maps: stim, x, y, value."""
    return features(spark, sf_dir).select("stim", F.floor(F.col("dim") / 8).alias("x"), (F.col("dim") % 8).alias("y"), "value")


@query(f"WITH {FEATURES} SELECT stim, dim, round(value / nullif(sqrt(sum(value * value) OVER (PARTITION BY stim)), 0), 6) AS value FROM f")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.posexplode(C.unit_norm(F.transform("embedding", lambda x: x.cast("double")))).alias("dim", "value"))
    return r6(v)


@query("SELECT vec_id AS stim, i AS class, (label = i)::BIGINT AS y FROM embeddings, (SELECT unnest(range(0, 10)) AS i)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.posexplode(C.one_hot(F.col("label"), 10)).alias("class", "y")))


@query(f"WITH {FEATURES} SELECT stim, dim, round(ln(1 + abs(value)) * tanh(value), 6) + 0.0 AS value FROM f")
def signed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features(spark, sf_dir).select("stim", "dim", C.signed_log(F.col("value")).alias("value")))


P = "p AS (SELECT vec_id AS stim, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abcd")])


@query(f"WITH {P}, t AS (SELECT stim, atan2(a, b) - atan2(c, d) + {math.pi} AS t FROM p) SELECT stim, round(t - {PI2} * floor(t / {PI2}) - {math.pi}, 6) AS delta FROM t")
def angle_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_points(spark, sf_dir).select("stim", C.angle_delta(F.atan2("a", "b"), F.atan2("c", "d")).alias("delta")))


@query(f"WITH {P} SELECT stim, round(0.2126::DOUBLE * a + 0.7152::DOUBLE * b + 0.0722::DOUBLE * c, 6) AS luma, round(0.299::DOUBLE * a + 0.587::DOUBLE * b + 0.114::DOUBLE * c, 6) AS gray FROM p")
def luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return r6(_points(spark, sf_dir).select("stim", C.luma(a, b, c).alias("luma"), C.grayscale(a, b, c).alias("gray")))


SETTINGS = "st AS (SELECT s_suppkey AS unit, 1 + s_suppkey % 4 AS n, 1 + s_suppkey % 3 AS m, 4 + s_nationkey / 8.0::DOUBLE AS a, 0.5 + s_suppkey % 8 * 0.5::DOUBLE AS s FROM supplier)"


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as units with a grid's settings each."""
    k = F.col("s_suppkey").cast("long")
    return table(spark, sf_dir, "supplier").select(k.alias("unit"), (1 + k % 4).alias("n"), (1 + k % 3).alias("n_sigma"), (4 + F.col("s_nationkey") / 8).alias("aperture"), (0.5 + k % 8 * 0.5).alias("sigma"))


@query(f"WITH {SETTINGS} SELECT unit, k AS model_id, round(CASE WHEN n > 1 THEN k // (m * n) * a / (n - 1) - a / 2 ELSE 0 END, 6) AS x, round(CASE WHEN n > 1 THEN k // m % n * a / (n - 1) - a / 2 ELSE 0 END, 6) AS y, round(s * exp(k % m * ln(8.0::DOUBLE) / greatest(m - 1, 1)), 6) AS sigma FROM (SELECT *, unnest(range(0, n * n * m)) AS k FROM st)")
def rf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's own grid of candidates, some of a single position."""
    return r6(fields.rf_grids(_settings(spark, sf_dir).withColumns({"low": F.col("sigma"), "high": 8 * F.col("sigma")}), ["unit"]))


@query(f"WITH {SETTINGS}, s AS (SELECT unit, s AS sigma, ceil(8 / (s * 0.5))::BIGINT AS n FROM st), i AS (SELECT unit, sigma, n, unnest(range(0, n)) AS i FROM s) SELECT unit, sigma, i, j, round(j * 8::DOUBLE / greatest(n - 1, 1) - 4, 6) AS x, round(i * 8::DOUBLE / greatest(n - 1, 1) - 4, 6) AS y FROM (SELECT *, unnest(range(0, n)) AS j FROM i)")
def rf_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around each unit's width the positions that suit it."""
    return r6(fields.rf_pyramids(_settings(spark, sf_dir), ["unit"], 8.0, 0.5))


@query(f"WITH {SETTINGS}, p AS (SELECT unit, n, a, s, unnest(range(0, n)) AS pos FROM st) SELECT unit, pos, round(CASE WHEN n > 1 THEN s - a / 2 + a * (pos + 0.5) / n ELSE s END, 6) AS centred, round(CASE WHEN n > 1 THEN s + a * pos / (n - 1) ELSE s END, 6) AS right_bound FROM p")
def linear_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's positions: cell middles around its centre, and from there to the right."""
    n, center, width = F.col("n"), F.col("sigma"), F.col("aperture")
    both = F.arrays_zip(fields.spaced_of(n, center, width).alias("centred"), fields.spaced_of(n, center, width, right_bound=True).alias("right_bound"))
    return r6(_settings(spark, sf_dir).select("unit", F.posexplode(both).alias("pos", "v")).select("unit", "pos", "v.centred", "v.right_bound"))


@query(f"WITH {SETTINGS} SELECT unit, pos, round(exp(ln(l + 1e-12) + (ln(a + 1e-12) - ln(l + 1e-12)) * pos / greatest(n - 1, 1)), 6) AS value FROM (SELECT unit, n, a, s - 0.5 AS l, unnest(range(0, n)) AS pos FROM st)")
def log_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's logarithmic axis, some from 0."""
    values = fields.axis_of(F.col("n"), F.col("sigma") - 0.5, F.col("aperture"), log=True)
    return r6(_settings(spark, sf_dir).select("unit", F.posexplode(values).alias("pos", "value")))


RFS = [(-1.0, 0.5, 1.5), (1.2, -2.1, 0.3), (0.0, 0.0, 1.0)]
G_SQL = "g AS (SELECT rf, dim, 1 / ({pi2} * s * s) * exp(-(power(px - x0, 2) + power(py - y0, 2)) / (2 * s * s)) AS w, s FROM (SELECT *, k AS dim, k % 8 - 3.5::DOUBLE AS px, 3.5::DOUBLE - k // 8 AS py FROM (SELECT unnest(range(0, 64)) AS k), (VALUES {rfs}) AS t(rf, x0, y0, s))), gw AS (SELECT rf, dim, CASE WHEN s < 0.5 THEN w / sum(w) OVER (PARTITION BY rf) ELSE w END AS w FROM g)".format(
    pi2=PI2, rfs=", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {s}::DOUBLE)" for i, (x, y, s) in enumerate(RFS))
)


def _pooled(spark: SparkSession, sf_dir: str, weights: list[list[float]]) -> DataFrame:
    """Maps pooled through several fields, inside each row."""
    x = F.col("x")
    pooled = F.array(*[C.dot(x, F.lit(w)) for w in weights])
    return r6(vectors(spark, sf_dir).select("stim", F.posexplode(pooled).alias("rf", "pooled")))


@query(f"WITH {FEATURES}, {G_SQL} SELECT stim, rf::BIGINT AS rf, round(sum(value * w), 6) AS pooled FROM f JOIN gw USING (dim) GROUP BY stim, rf")
def gaussian_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir, fields.weight_arrays(fields.gaussian_stack(spark, 8, RFS)))


@query()
def gaussian_mass_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As gaussian_pool, with each pixel's mass by the error function, which neither engine's SQL has, in narrow fields."""
    return _pooled(spark, sf_dir, fields.weight_arrays(fields.gaussian_mass_stack(spark, 8, RFS)))


TURNED = f"WITH {SETTINGS}, r AS (SELECT unit, k // 8 AS x, k % 8 AS y, k // 8 - n AS dx, k % 8 - a / 2 AS dy, s / 4 AS sx, s / 8 AS sy, s AS t FROM st, (SELECT unnest(range(0, 64)) AS k)) SELECT unit, x, y, round(0.3 + exp(0.2::DOUBLE) * exp(-(power(dx * cos(t) - dy * sin(t), 2) / (2 * exp(2 * sx)) + power(dx * sin(t) + dy * cos(t), 2) / (2 * exp(2 * sy)))), 6) AS w FROM r"


@query(TURNED)
def rotated_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's turned Gaussian over the pixels of a map."""
    s, k = F.col("sigma"), F.col("k")
    f = _settings(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).withColumns({"x": F.floor(k / 8), "y": k % 8})
    return r6(f.select("unit", "x", "y", C.rotated_gaussian(F.col("x"), F.col("y"), F.col("n"), F.col("aperture") / 2, s / 4, s / 8, s, 0.2, 0.3).alias("w")))


WRAPPED = "CASE WHEN abs({0}) <= abs({0} + {pi2}) AND abs({0}) <= abs({0} - {pi2}) THEN {0} WHEN abs({0} + {pi2}) <= abs({0} - {pi2}) THEN {0} + {pi2} ELSE {0} - {pi2} END"


@query(
    f"WITH {P}, t AS (SELECT stim, atan2(b, a) AS polar, -(10 * d + CASE WHEN a < c THEN {math.pi / 2} ELSE 0 END) AS m FROM p), h AS (SELECT stim, polar, m - {PI2} * floor(m / {PI2}) - {math.pi} AS phi FROM t), "
    f"o AS (SELECT stim, phi - polar AS u, CASE WHEN phi > 0 THEN phi - {math.pi} ELSE phi + {math.pi} END - polar AS v FROM h), w AS (SELECT stim, {WRAPPED.format('u', pi2=PI2)} AS u, {WRAPPED.format('v', pi2=PI2)} AS v FROM o) SELECT stim, round(CASE WHEN abs(u) < abs(v) THEN u ELSE v END, 6) AS delta FROM w"
)
def orientation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far fields' longer axes are from pointing at the centre."""
    a, b, c, d = (F.col(x) for x in "abcd")
    return r6(_points(spark, sf_dir).select("stim", C.orientation_delta(a, b, a, c, 10 * d).alias("delta")))


@query(f"WITH {P} SELECT stim, round(200 * (a * a) / nullif(b * b, 0) * sqrt(power(0.1 * d / nullif(b, 0), 2) + power(0.1 * c / nullif(a, 0), 2)), 4) AS error FROM p WHERE abs(b) > 0.01")
def tuning_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propagated error of a share of variance."""
    a, b, c, d = (F.col(x) for x in "abcd")
    return _points(spark, sf_dir).where(F.abs(b) > 0.01).select("stim", F.round(C.ratio_error(a, 0.1 * c, b, 0.1 * d), 4).alias("error"))


AREA = "o AS (SELECT d.k AS dst, s.k AS src, (least(s.k + 1, (d.k + 1) * (8.0::DOUBLE / 3)) - greatest(s.k, d.k * (8.0::DOUBLE / 3))) / (8.0::DOUBLE / 3) AS w FROM (SELECT unnest(range(0, 3)) AS k) d, (SELECT unnest(range(0, 8)) AS k) s)"


@query(f"WITH {MAPS}, {AREA} SELECT stim, a.dst AS x, b.dst AS y, round(sum(value * a.w * b.w), 6) AS value FROM mp JOIN o a ON a.src = x AND a.w > 1e-12 JOIN o b ON b.src = y AND b.w > 1e-12 GROUP BY stim, a.dst, b.dst")
def area_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fields.resample(maps(spark, sf_dir), fields.sampling_matrix(spark, 8, 3, preserve_norm=False), ["stim"]).select("stim", "x", "y", "value"))


LINEAR = "o0 AS (SELECT k AS dst, lo + s AS src, CASE s WHEN 0 THEN 1 - (pos - lo) ELSE pos - lo END AS w FROM (SELECT k, k * 7::DOUBLE / 11 AS pos, least(floor(k * 7::DOUBLE / 11), 6)::BIGINT AS lo FROM (SELECT unnest(range(0, 12)) AS k)), (SELECT unnest([0, 1]) AS s)), o AS (SELECT dst, src, w / sum(w) OVER (PARTITION BY src) AS w FROM o0)"


@query(f"WITH {MAPS}, {LINEAR} SELECT stim, a.dst AS x, b.dst AS y, round(sum(value * a.w * b.w), 6) + 0.0 AS value FROM mp JOIN o a ON a.src = x JOIN o b ON b.src = y GROUP BY stim, a.dst, b.dst")
def linear_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(fields.resample(maps(spark, sf_dir), fields.sampling_matrix(spark, 8, 12), ["stim"]).select("stim", "x", "y", "value"))


@query(f"WITH {MAPS}, s AS (SELECT stim, x, y, value, exp(value - max(value) OVER (PARTITION BY stim)) AS e FROM mp) SELECT stim, round(sum(value * e) / sum(e), 6) AS pooled FROM s GROUP BY stim")
def spatial_softmax_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("e", F.transform("x", lambda v: F.exp(v - F.array_max("x"))))
    return r6(v.select("stim", (C.dot(F.col("x"), F.col("e")) / F.aggregate("e", F.lit(0.0), lambda s, v: s + v)).alias("pooled")))


@query(f"WITH {FEATURES} SELECT stim, dim // 16 AS layer, round(avg(value), 6) AS mean FROM f GROUP BY ALL")
def spatial_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.aggregate(F.slice("x", i * 16 + 1, 16), F.lit(0.0), lambda s, v: s + v) / 16)
    return r6(vectors(spark, sf_dir).select("stim", F.posexplode(means).alias("layer", "mean")))


@query(f"WITH {FEATURES}, w AS (SELECT stim, dim % 8 / 7::DOUBLE - 0.5 AS x, 0.5 - dim // 8 / 7::DOUBLE AS y, greatest(value - avg(value) OVER (PARTITION BY stim), 0) AS w FROM f), c AS (SELECT stim, sum(x * w) / nullif(sum(w), 0) AS cx, sum(y * w) / nullif(sum(w), 0) AS cy FROM w GROUP BY stim) SELECT stim, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(sqrt(sum((x - cx) * (x - cx) * w) / nullif(sum(w), 0)), 6) AS sx, round(sqrt(sum((y - cy) * (y - cy) * w) / nullif(sum(w), 0)), 6) AS sy FROM w JOIN c USING (stim) GROUP BY stim")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and spread, along x and y, of what exceeds the mean; the map is one wide and centred, y points up."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    xs, ys = F.lit([i % 8 / 7 - 0.5 for i in range(64)]), F.lit([0.5 - i // 8 / 7 for i in range(64)])
    v = vectors(spark, sf_dir).withColumn("mean", total(F.col("x")) / F.size("x")).withColumn("w", F.transform("x", lambda v: F.greatest(v - F.col("mean"), F.lit(0.0)))).withColumn("total", total(F.col("w")))
    v = v.withColumns({"cx": F.try_divide(C.dot(xs, F.col("w")), F.col("total")), "cy": F.try_divide(C.dot(ys, F.col("w")), F.col("total"))})
    spread = lambda at, c: F.sqrt(F.try_divide(C.dot(F.transform(at, lambda p: (p - F.col(c)) * (p - F.col(c))), F.col("w")), F.col("total")))
    return r6(v.select("stim", "cx", "cy", spread(xs, "cx").alias("sx"), spread(ys, "cy").alias("sy")))


@query("SELECT p_partkey AS roi_id, string_split(p_name, ' ')[1] AS roi_name FROM part WHERE len(string_split(p_partkey || ' ' || p_name, ' ')) >= 2")
def ctab_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour-table lines, id then name, split at white space."""
    lines = table(spark, sf_dir, "part").select(F.concat_ws("  ", "p_partkey", "p_name").alias("value"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where(F.size(parts) >= 2).select(parts[0].cast("long").alias("roi_id"), parts[1].alias("roi_name"))


@query("SELECT event_id, 'k' AS key, (props->>'$.k')::BIGINT AS value FROM events")
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string, bigint>")))


@query(f"WITH {RECORDING} SELECT event_id, channel, code, row_number() OVER w AS rep FROM e WINDOW w AS (PARTITION BY channel, code ORDER BY second, event_id) QUALIFY row_number() OVER w <= 2")
def first_k_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_k(recording(spark, sf_dir), ["channel", "code"], ["second", "event_id"], 2).select("event_id", "channel", "code", "rep")


@query(f"WITH {RECORDING} SELECT event_id, channel, code FROM e QUALIFY code IS DISTINCT FROM lag(code) OVER (PARTITION BY channel ORDER BY second, event_id)")
def event_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.onsets(recording(spark, sf_dir), ["channel"], ["second", "event_id"], "code", size=604_800).select("event_id", "channel", "code")


EPOCH = RECORDING + ", t AS (SELECT event_id AS trial, channel, second // 3600 AS hour FROM e WHERE code = (SELECT min(code) FROM e)), ep AS (SELECT trial, t.channel, event_id, second // 3600 - hour AS off, value FROM t JOIN e ON e.channel = t.channel AND second // 3600 BETWEEN hour - 6 AND hour + 12)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = recording(spark, sf_dir).withColumn("at", F.expr("second div 3600"))
    code = e.agg(F.min("code")).first()[0]
    triggers = e.where(F.col("code") == code).select(F.col("event_id").alias("trial"), "channel", "at")
    return epochs.epochs(triggers, e.select("channel", "at", "event_id", "value"), -6, 12, ["channel"])


@query(f"WITH {EPOCH} SELECT trial, event_id, off::BIGINT AS off, value FROM ep")
def epoch_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _epochs(spark, sf_dir).select("trial", "event_id", F.col("offset").cast("long").alias("off"), "value")


@query(f"WITH {EPOCH} SELECT trial, event_id, round(value - avg(CASE WHEN off <= 0 THEN value END) OVER (PARTITION BY trial), 6) AS corrected FROM ep")
def baseline_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(epochs.baseline(_epochs(spark, sf_dir), ["trial"], "value", F.col("offset") <= 0).select("trial", "event_id", "corrected"))


@query(f"WITH {RECORDING}, k AS (SELECT *, row_number() OVER (PARTITION BY code, second // 864000 ORDER BY second, event_id) AS i FROM e), s AS (SELECT code, second // 864000 AS session, event_id, value FROM k WHERE i <= 20) SELECT code, row_number() OVER (PARTITION BY code ORDER BY session, event_id) AS rep, value FROM s")
def condition_repeat_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of each condition, 20 a session at most, numbered across sessions."""
    e = recording(spark, sf_dir).withColumn("session", F.expr("second div 864000"))
    kept = splits.first_k(e, ["code", "session"], ["second", "event_id"], 20, "i")
    return kept.withColumn("rep", F.row_number().over(Window.partitionBy("code").orderBy("session", "event_id")).cast("long")).select("code", "rep", "value")


VAR = FEATURES + ", v AS (SELECT dim, dim // 16 AS layer, round(var_pop(value), 9) AS var FROM f GROUP BY dim)"


def _variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("dim").agg(F.round(F.var_pop("value"), 9).alias("var")).withColumn("layer", F.expr("dim div 16"))


@query(f"WITH {VAR} SELECT layer, dim FROM v QUALIFY row_number() OVER (PARTITION BY layer ORDER BY var DESC, dim) <= 5")
def topk_variance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.first_k(_variances(spark, sf_dir), ["layer"], [F.desc("var"), F.asc("dim")], 5).select("layer", "dim")


@query("WITH g AS (SELECT p_size AS size, count(*) AS n FROM part GROUP BY p_size), o AS (SELECT size, n, (sum(n) OVER (ORDER BY size DESC) - n)::BIGINT AS start FROM g) SELECT p_partkey AS layer, size::BIGINT AS size, n, start FROM part JOIN o ON p_size = size")
def layer_size_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as layers: those of one spatial size form a group, the largest first; each layer has its group's members and offset."""
    layers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("layer"), F.col("p_size").cast("long").alias("size"))
    g = layers.groupBy("size").agg(F.count("*").alias("n"))
    starts = g.withColumn("start", F.sum("n").over(Window.orderBy(F.desc("size"))) - F.col("n"))  # one row a size
    return layers.join(starts, "size").select("layer", "size", "n", "start")


@query(f"WITH {VAR} SELECT stim, round(sum(value), 6) AS value FROM f JOIN (SELECT dim FROM v QUALIFY row_number() OVER (PARTITION BY layer ORDER BY var DESC, dim) <= 5) USING (dim) GROUP BY stim")
def filtered_feature_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = splits.first_k(_variances(spark, sf_dir), ["layer"], [F.desc("var"), F.asc("dim")], 5).select("dim")
    return r6(features(spark, sf_dir).join(kept, "dim", "left_semi").groupBy("stim").agg(F.sum("value").alias("value")))


@query(f"WITH {FEATURES} SELECT stim, dim, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w = 0 THEN 1 ELSE stddev_pop(value) OVER w END, 6) AS value FROM f WINDOW w AS (PARTITION BY dim)")
def standardise_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    scale = f.groupBy("dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return r6(f.join(scale, "dim").select("stim", "dim", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("value")))


@query(f"WITH {FEATURES} SELECT stim, u AS unit, round(0.1 * u + sum(value * sin((dim + 1) * (u + 1))), 6) AS value FROM f, (SELECT unnest(range(0, 5)) AS u) GROUP BY stim, u")
def linear_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from coefficients per unit, in blocks of units; a selection of units is a filter on the coefficients."""
    coef = spark.range(5).select(F.col("id").alias("unit"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda d: F.sin(d * (F.col("id") + 1))).alias("coef"), (F.col("id") * 0.1).alias("intercept"))
    x = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return r6(linalg.predict(x, coef, keys=["stim"], size=2))


@query(f"WITH {MEASUREMENTS} SELECT unit, round(covar_pop(predicted, measured) / nullif(var_pop(predicted), 0), 4) AS slope, round(avg(measured) - covar_pop(predicted, measured) / nullif(var_pop(predicted), 0) * avg(predicted), 4) AS intercept FROM m GROUP BY unit")
def simple_regression_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope = F.try_divide(F.covar_pop("predicted", "measured"), F.var_pop("predicted"))
    g = measurements(spark, sf_dir).groupBy("unit").agg(slope.alias("slope"), F.avg("measured").alias("y"), F.avg("predicted").alias("x"))
    return g.select("unit", F.round("slope", 4).alias("slope"), F.round(F.col("y") - F.col("slope") * F.col("x"), 4).alias("intercept"))


def _xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    return e.select("vec_id", F.slice("e", 1, 20).alias("x"), F.slice("e", 21, 5).alias("y"), (F.col("vec_id") % 5 == 0).alias("held"))


@query()
def multi_output_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = linalg.ols(_xy(spark, sf_dir), "x", "y")
    return r6(spark.createDataFrame([(i, j, float(w[i, j])) for i in range(w.shape[0]) for j in range(w.shape[1])], "row long, output long, coef double"))


@query()
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    xy = _xy(spark, sf_dir)
    mean, loadings, _ = linalg.pca(xy, "x", 3)
    return r6(linalg.project(xy, "x", mean, loadings).select(F.col("vec_id").alias("stim"), F.posexplode("scores").alias("component", "score")))


@query()
def ridge_grid_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(spark.createDataFrame(linalg.ridge_grid(_xy(spark, sf_dir), "x", "y", "held", [0.0, 0.1, 1.0, 10.0, 100.0])))


@query(f"WITH {MEASUREMENTS}, t AS (SELECT unit, sum(predicted * measured) AS xv, sum(predicted * predicted) AS xx FROM m WHERE stim % 5 <> 0 GROUP BY unit), l AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 1000), (2, 100000)) AS l(i, penalty)), h AS (SELECT unit, i, penalty, round(sum(power(measured - predicted * xv / (xx + penalty), 2)) / 1e6, 6) AS loss FROM m JOIN t USING (unit), l WHERE stim % 5 = 0 GROUP BY ALL) SELECT unit, penalty, loss FROM h QUALIFY row_number() OVER (PARTITION BY unit ORDER BY loss, i) = 1")
def ridge_grid_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature: the loss of every penalty from four sums per unit, the earliest of the best wins."""
    m = measurements(spark, sf_dir)
    x, v, train = F.col("predicted"), F.col("measured"), F.col("stim") % 5 != 0
    total = lambda c, on: F.sum(F.when(on, c))
    s = m.groupBy("unit").agg(total(x * v, train).alias("xv"), total(x * x, train).alias("xx"), total(x * x, ~train).alias("hxx"), total(x * v, ~train).alias("hxv"), total(v * v, ~train).alias("hvv"))
    losses = []
    for i, p in enumerate((0.0, 1000.0, 100000.0)):
        b = F.col("xv") / (F.col("xx") + p)
        losses.append(F.struct(F.round((F.col("hvv") - 2 * b * F.col("hxv") + b * b * F.col("hxx")) / 1e6, 6).alias("loss"), F.lit(i).alias("i"), F.lit(p).alias("penalty")))
    return s.where("hvv IS NOT NULL AND xv IS NOT NULL").withColumn("best", F.least(*losses)).select("unit", "best.penalty", "best.loss")


PART = FEATURES + ", w AS (SELECT stim, dim // 16 AS part, sum(value * (1 + dim % 3)) AS y FROM f GROUP BY ALL), a AS (SELECT stim, any_value(label)::DOUBLE AS label FROM f GROUP BY stim), p AS (SELECT part, stim, y, sum(y) OVER (PARTITION BY stim) AS total, label FROM w JOIN a USING (stim)), s AS (SELECT part, {r1} AS incl, {r2} AS excl, {r3} AS full_r FROM p GROUP BY part)".format(r1=R_SQL.format("y", "label"), r2=R_SQL.format("(total - y)", "label"), r3=R_SQL.format("total", "label"))


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with one partition of the features only, without it, and with all."""
    f = features(spark, sf_dir)
    y = f.groupBy("stim", F.expr("dim div 16").alias("part")).agg(F.sum(F.col("value") * (1 + F.col("dim") % 3)).alias("y"), F.max("label").cast("double").alias("label"))
    p = y.withColumn("total", F.sum("y").over(Window.partitionBy("stim")))
    r = lambda x: stats.correlation(x, F.col("label"))
    return p.groupBy("part").agg(r(F.col("y")).alias("incl"), r(F.col("total") - F.col("y")).alias("excl"), r(F.col("total")).alias("full_r"))


@query(f"WITH {PART} SELECT part, round(incl, 6) AS incl, round(excl, 6) AS excl, round(full_r * full_r - excl * excl, 6) AS unique_r2 FROM s")
def ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_ablation(spark, sf_dir).select("part", "incl", "excl", (F.col("full_r") * F.col("full_r") - F.col("excl") * F.col("excl")).alias("unique_r2")))


@query(f"WITH {PART}, q AS (SELECT part, incl * incl AS v FROM s) SELECT part, round(v / nullif(sum(v) OVER (), 0), 6) AS share, round((v - min(v) OVER ()) / nullif(max(v) OVER () - min(v) OVER (), 0), 6) AS scaled, (row_number() OVER (ORDER BY round(v, 9) DESC, part) = 1) AS preferred FROM q")
def tuning_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each partition's share, min-max scaled value, and whether it is the preferred one."""
    q = _ablation(spark, sf_dir).select("part", (F.col("incl") * F.col("incl")).alias("v"))
    everything = Window.partitionBy(F.lit(1))
    first = F.row_number().over(Window.orderBy(F.desc(F.round("v", 9)), "part")) == 1
    low, high = F.min("v").over(everything), F.max("v").over(everything)
    return r6(q.select("part", F.try_divide(F.col("v"), F.sum("v").over(everything)).alias("share"), F.try_divide(F.col("v") - low, high - low).alias("scaled"), first.alias("preferred")))


SPREAD = f"WITH {FEATURES}, q AS (SELECT label, dim // 4 AS part, avg(value * value) AS v FROM f GROUP BY ALL), n AS (SELECT label, coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0) AS v, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY label)), r AS (SELECT label, n, v, row_number() OVER (PARTITION BY label ORDER BY v) - 1 AS i FROM n), l AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY i) AS nv FROM r), s AS (SELECT label, coalesce(max(1 - (i + (0.5 - v) / (nv - v)) / (n - 1)) FILTER (v < 0.5 AND nv >= 0.5), 0) AS spread FROM l GROUP BY label) "


def _tuning_spread(q: DataFrame) -> DataFrame:
    """(label, part, v) to (label, spread): share of a label's sorted, scaled parts above half height, by linear interpolation between
    ranks; 0 for a label whose parts are all the same."""
    w = Window.partitionBy("label")
    low, high = F.min("v").over(w), F.max("v").over(w)
    n = q.withColumns({"v": F.coalesce(F.try_divide(F.col("v") - low, high - low), F.lit(0.0)), "n": F.count("*").over(w)})
    o = w.orderBy("v")
    n = n.withColumns({"i": F.row_number().over(o) - 1, "nv": F.lead("v").over(o)})
    at = F.when((F.col("v") < 0.5) & (F.col("nv") >= 0.5), 1 - (F.col("i") + (0.5 - F.col("v")) / (F.col("nv") - F.col("v"))) / (F.col("n") - 1))
    return n.groupBy("label").agg(F.coalesce(F.max(at), F.lit(0.0)).alias("spread"))


@query(SPREAD + "SELECT label, round(spread, 6) AS spread FROM s")
def tuning_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = features(spark, sf_dir).groupBy("label", F.expr("dim div 4").alias("part")).agg(F.avg(F.col("value") * F.col("value")).alias("v"))
    return r6(_tuning_spread(q))


@query(SPREAD + "SELECT round(avg(spread), 6) AS mean, round(median(spread), 6) AS median, round(min(spread), 6) AS low, round(max(spread), 6) AS high FROM s")
def tuning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tuning_spread(spark, sf_dir)
    return r6(s.agg(F.avg("spread").alias("mean"), F.median("spread").alias("median"), F.min("spread").alias("low"), F.max("spread").alias("high")))


BOOT = f"WITH v AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, (SELECT count(*) FROM embeddings) AS n FROM embeddings), d AS (SELECT rep, (rep * 7919 + draw * 104729 + draw * draw * rep) % n AS i FROM (SELECT unnest(range(0, 20)) AS rep), (SELECT i AS draw, n FROM v)), c AS (SELECT rep, coalesce({R_SQL.format('a', 'b')}, 0) AS r FROM d JOIN v USING (i) GROUP BY rep) "


@query(BOOT + "SELECT round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r, count(*) AS n FROM c")
def bootstrap_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation over resamples with replacement; draws come from integer arithmetic, so any engine repeats them."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    n, reps = v.count(), F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))
    # How often each replicate draws each row is counted first, so rows meet one array of counts instead of all their draws.
    draws = v.select(F.col("i").alias("draw"), F.explode(reps).alias("rep"))
    draws = draws.select("rep", ((F.col("rep") * 7919 + F.col("draw") * 104729 + F.col("draw") * F.col("draw") * F.col("rep")) % n).alias("i")).groupBy("i", "rep").agg(F.count("*").alias("m"))
    held = draws.groupBy("i").agg(F.collect_list(F.struct("rep", "m")).alias("held"))  # one a replicate at most
    d = v.join(held, "i").select("a", "b", F.explode("held").alias("h")).select("a", "b", "h.rep", "h.m")
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    s = d.groupBy("rep").agg(F.sum("m").alias("n"), *[F.sum(m * e).alias(name) for name, e in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))])
    spread = lambda xy, x, y: F.col(xy) / F.col("n") - F.col(x) / F.col("n") * F.col(y) / F.col("n")
    r = F.try_divide(spread("sab", "sa", "sb"), F.sqrt(spread("saa", "sa", "sa") * spread("sbb", "sb", "sb")))
    c = s.select(F.coalesce(r, F.lit(0.0)).alias("r"))
    return r6(c.agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"), F.count("*").alias("n")))


HEAD = f"WITH {FEATURES}, l AS (SELECT stim, dim // 16 AS layer, (dim % 16) // 4 AS x, dim % 4 AS y, value FROM f), rf AS (SELECT layer, x, y, exp(s) / sum(exp(s)) OVER (PARTITION BY layer) AS w FROM (SELECT k // 16 AS layer, (k % 16) // 4 AS x, k % 4 AS y, sin(k::DOUBLE) AS s FROM (SELECT unnest(range(0, 64)) AS k))), p AS (SELECT stim, layer, sum(value * w) AS phi FROM l JOIN rf USING (layer, x, y) GROUP BY ALL) "


def _head(spark: SparkSession, sf_dir: str, phi: list) -> DataFrame:
    """Signed log of pooled features, then a linear read-out, inside each row."""
    value = F.lit(0.25)
    for layer, p in enumerate(phi):
        value = value + (layer + 1) * C.signed_log(p)
    return r6(vectors(spark, sf_dir).select("stim", value.alias("value")))


@query(HEAD + "SELECT stim, round(0.25 + sum((layer + 1) * ln(1 + abs(phi)) * tanh(phi)), 6) AS value FROM p GROUP BY stim")
def fwrf_head_layerwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature maps of four layers pooled through a softmax field of their own each."""
    rf = [fields.softmax([math.sin(k) for k in range(16 * layer, 16 * layer + 16)]) for layer in range(4)]
    return _head(spark, sf_dir, [C.dot(F.slice("x", 16 * layer + 1, 16), F.lit(w)) for layer, w in enumerate(rf)])


SHARED = f"WITH {FEATURES}, rf AS (SELECT k // 4 AS x, k % 4 AS y, exp(sin(k::DOUBLE)) / sum(exp(sin(k::DOUBLE))) OVER () AS w FROM (SELECT unnest(range(0, 16)) AS k)), half AS (SELECT x // 2 AS x, y // 2 AS y, sum(w) AS w FROM rf GROUP BY ALL), p AS (SELECT stim, 0 AS layer, sum(value * w / 4) AS phi FROM f JOIN rf ON x = dim // 16 AND y = dim % 8 // 2 GROUP BY stim UNION ALL SELECT stim, 1, sum(value * w) FROM f JOIN rf ON x = dim // 4 AND y = dim % 4 WHERE dim < 16 GROUP BY stim UNION ALL SELECT stim, 2, sum(value * w) FROM f JOIN half ON x = (dim - 16) // 2 AND y = dim % 2 WHERE dim BETWEEN 16 AND 19 GROUP BY stim UNION ALL SELECT stim, 3, value FROM f WHERE dim = 20) "


@query(SHARED + "SELECT stim, round(0.25 + sum((layer + 1) * ln(1 + abs(phi)) * tanh(phi)), 6) AS value FROM p GROUP BY stim")
def fwrf_head_single_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One softmax field for maps of 8, 4, 2 and 1 pixels a side: finer maps are averaged to its grid, it is summed to coarser ones, and
    a map of one pixel passes as it is."""
    rf = fields.softmax([math.sin(k) for k in range(16)])
    weights = [fields.shared_field(rf, 4, side) for side in (8, 4, 2, 1)]
    starts = (0, 0, 16, 20)
    return _head(spark, sf_dir, [C.dot(F.slice("x", at + 1, len(w)), F.lit(w)) for at, w in zip(starts, weights)])


@query(f"WITH {MAPS}, d AS (SELECT stim, abs(value - lag(value) OVER (PARTITION BY stim, y ORDER BY x)) AS dx, abs(value - lag(value) OVER (PARTITION BY stim, x ORDER BY y)) AS dy FROM mp) SELECT stim, round(coalesce(sum(dx * dx), 0) + coalesce(sum(dy * dy), 0), 6) AS penalty FROM d GROUP BY stim")
def rf_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of squared steps along both axes of a map."""
    return r6(vectors(spark, sf_dir).select("stim", fields.roughness(F.col("x"), 8, 2.0).alias("penalty")))


@query(f"WITH {MAPS}, d AS (SELECT stim, abs(value - lag(value) OVER (PARTITION BY stim, y ORDER BY x)) AS dx, abs(value - lag(value) OVER (PARTITION BY stim, x ORDER BY y)) AS dy FROM mp) SELECT stim, round(coalesce(sum(dx), 0) + coalesce(sum(dy), 0), 6) AS penalty FROM d GROUP BY stim")
def rf_total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of absolute steps along both axes of a map."""
    return r6(vectors(spark, sf_dir).select("stim", fields.roughness(F.col("x"), 8, 1.0).alias("penalty")))
