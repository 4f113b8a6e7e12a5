"""Queries over trials: selection, joins, sets, splits, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..operators import stats
from ..sources.tables import FEATURES, MEASUREMENTS, RECORDING, UNIT_REGIONS, features, measurements, recording, table, unit_regions

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, integers as longs, so that both engines agree to the bit."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns])


ACCURACY = f"""
WITH {MEASUREMENTS},
z AS (SELECT unit, stim, predicted, coalesce((measured - avg(measured) OVER w) / nullif(stddev_pop(measured) OVER w, 0), 0) AS z FROM m WINDOW w AS (PARTITION BY session, unit)),
s AS (SELECT unit, stim, avg(z) AS z, avg(predicted) AS p, count(*) AS n, CASE WHEN count(*) > 1 THEN var_samp(z) END AS var FROM z GROUP BY unit, stim),
g AS (SELECT unit, covar_pop(z, p) / nullif(sqrt(var_pop(z) * var_pop(p)), 0) AS r,
  sqrt(greatest(CASE WHEN count(*) FILTER (n >= 2) >= 2 THEN var_samp(z) FILTER (n >= 2) END - avg(var / n) FILTER (n >= 2), 0) / nullif(avg(var) FILTER (n >= 2), 0)) AS q FROM s GROUP BY unit),
c AS (SELECT unit, r, CASE WHEN r IS NOT NULL THEN greatest(r, 0) * greatest(r, 0) END AS r2,
  CASE WHEN q IS NULL THEN NULL WHEN q = 0 THEN 1e-14 ELSE q * q / (q * q + 1.0::DOUBLE / 3) END AS nc FROM g)
"""


@query(ACCURACY + "SELECT unit, round(r, 6) AS r, round(r2, 6) AS r2, round(nc, 6) AS noise_ceiling, CASE WHEN r2 / nc IS NOT NULL THEN round(least(r2 / nc * 100, 100), 6) END AS explained_variance FROM c")
def encoding_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.encoding_accuracy(measurements(spark, sf_dir)))


@query("SELECT l_partkey AS stim, l_suppkey AS unit, round(avg(l_extendedprice), 6) AS measured, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25 GROUP BY ALL")
def repeat_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("stim"))
    trials = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("stim"), F.col("l_suppkey").alias("unit"), F.col("l_extendedprice").alias("measured"))
    return r6(stats.repeat_mean(trials.join(chosen, "stim"), ["stim", "unit"], ["measured"]))


@query("""
WITH k AS (SELECT l_partkey AS stim, count(*) AS seen FROM lineitem WHERE l_orderkey < 10000 GROUP BY ALL)
SELECT p_partkey AS stim, coalesce(seen, 0) AS seen, CASE WHEN p_size > 25 THEN 'train' WHEN seen = 3 THEN 'test' ELSE 'val' END AS split FROM part LEFT JOIN k ON p_partkey = stim""")
def split_by_repeat_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of shared stimuli those with exactly three trials inside the sessions that all subjects have go to test, the rest to validation, unseen
    ones too; stimuli of one subject only train."""
    from ..operators.splits import repeat_split

    stimuli = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stim"), "p_size")
    trials = table(spark, sf_dir, "lineitem").where("l_orderkey < 10000").select(F.col("l_partkey").alias("stim"))
    return repeat_split(stimuli, trials, "stim", F.col("p_size") <= 25).select("stim", "seen", "split")


Z_SQL = "SELECT session, unit, stim, measured, round(coalesce((measured - avg(measured) OVER w) / nullif(stddev_pop(measured) OVER w, 0), 0), 6) AS z FROM {0} WINDOW w AS (PARTITION BY session, unit)"


@query(f"WITH {MEASUREMENTS} " + Z_SQL.format("m"))
def session_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.zscore(measurements(spark, sf_dir), "measured", ["session", "unit"]).select("session", "unit", "stim", "measured", "z"))


@query(f"WITH {MEASUREMENTS}, n AS (SELECT session, unit, stim, CASE WHEN stim % 7 <> 0 THEN measured END AS measured FROM m) " + Z_SQL.format("n"))
def session_zscore_omit_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).withColumn("measured", F.when(F.col("stim") % 7 != 0, F.col("measured")))
    return r6(stats.zscore(m, "measured", ["session", "unit"]).select("session", "unit", "stim", "measured", "z"))


@query(f"WITH {FEATURES} SELECT dim, round(avg(value), 6) AS mean, round(stddev_pop(value) + 1e-6, 6) AS scale, round(avg(value * value) - avg(value) * avg(value), 6) AS var FROM f GROUP BY dim")
def column_moments_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return r6(features(spark, sf_dir).groupBy("dim").agg(F.avg(v).alias("mean"), (F.stddev_pop(v) + 1e-6).alias("scale"), (F.avg(v * v) - F.avg(v) * F.avg(v)).alias("var")))


R_SQL = "covar_pop({0}, {1}) / nullif(sqrt(var_pop({0}) * var_pop({1})), 0)"


@query(f"WITH {MEASUREMENTS} SELECT unit, round({R_SQL.format('measured', 'predicted')}, 6) AS r FROM m GROUP BY unit")
def unit_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(measurements(spark, sf_dir).groupBy("unit").agg(stats.correlation(F.col("measured"), F.col("predicted")).alias("r")))


@query(f"WITH {MEASUREMENTS}, a AS (SELECT unit, stim, avg(measured) AS measured, avg(predicted) AS predicted FROM m GROUP BY ALL) SELECT unit, round({R_SQL.format('measured', 'predicted')}, 6) AS r FROM a GROUP BY unit")
def correlation_after_averaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.repeat_mean(measurements(spark, sf_dir), ["unit", "stim"], ["measured", "predicted"])
    return r6(a.groupBy("unit").agg(stats.correlation(F.col("measured"), F.col("predicted")).alias("r")))


@query(f"WITH {MEASUREMENTS}, a AS (SELECT unit, stim, avg(measured) AS measured FROM m GROUP BY ALL), p AS (SELECT unit, stim, session, avg(predicted) AS predicted FROM m GROUP BY ALL) SELECT session, unit, round({R_SQL.format('measured', 'predicted')}, 6) AS r FROM p JOIN a USING (unit, stim) GROUP BY session, unit")
def correlation_per_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each session alone against responses averaged over all of them."""
    m = measurements(spark, sf_dir)
    a = m.groupBy("unit", "stim").agg(F.avg("measured").alias("measured"))
    p = m.groupBy("unit", "stim", "session").agg(F.avg("predicted").alias("predicted"))
    return r6(p.join(a, ["unit", "stim"]).groupBy("session", "unit").agg(stats.correlation(F.col("measured"), F.col("predicted")).alias("r")))


@query(f"WITH {FEATURES}, a AS (SELECT dim, coalesce({R_SQL.format('value', 'label::DOUBLE')}, 0) AS r FROM f GROUP BY dim) SELECT round(median(r), 6) AS median_r, round(max(r), 6) AS max_r, count(*) AS n FROM a")
def validation_correlation_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = features(spark, sf_dir).groupBy("dim").agg(F.coalesce(stats.correlation(F.col("value"), F.col("label").cast("double")), F.lit(0.0)).alias("r"))
    return r6(a.agg(F.median("r").alias("median_r"), F.max("r").alias("max_r"), F.count("*").alias("n")))


EV = ACCURACY + f", v AS (SELECT unit, nc, CASE WHEN r2 / nc IS NOT NULL THEN least(r2 / nc * 100, 100) END AS ev FROM c), {UNIT_REGIONS} "


@query(EV + "SELECT roi, round(avg(ev), 6) AS ev, count(*) AS units FROM v JOIN u USING (unit) GROUP BY roi")
def roi_mean_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stats.encoding_accuracy(measurements(spark, sf_dir)).join(unit_regions(spark, sf_dir), "unit")
    return r6(a.groupBy("roi").agg(F.avg("explained_variance").alias("ev"), F.count("*").alias("units")))


@query(EV + "SELECT roi, round(avg(ev), 6) AS ev, count(*) AS units FROM v JOIN u USING (unit) WHERE nc >= 0.1 GROUP BY roi")
def roi_mean_thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units under a noise ceiling of 0.1 don't count."""
    a = stats.encoding_accuracy(measurements(spark, sf_dir)).where("noise_ceiling >= 0.1").join(unit_regions(spark, sf_dir), "unit")
    return r6(a.groupBy("roi").agg(F.avg("explained_variance").alias("ev"), F.count("*").alias("units")))


@query(EV + "SELECT round(avg(CASE WHEN nc >= 0.1 THEN ev END), 6) AS ev, count(CASE WHEN nc >= 0.1 THEN ev END) AS units FROM v")
def subject_nanmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same threshold, as missing values that the mean skips."""
    kept = F.when(F.col("noise_ceiling") >= 0.1, F.col("explained_variance"))
    return r6(stats.encoding_accuracy(measurements(spark, sf_dir)).agg(F.avg(kept).alias("ev"), F.count(kept).alias("units")))


@query("SELECT o_orderkey AS trial, c_custkey AS img, c_mktsegment AS segment, count(*) AS rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trial")).agg(F.count("*").alias("rows"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial"), F.col("o_custkey").alias("img"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img"), F.col("c_mktsegment").alias("segment"))
    return rows.join(orders, "trial").join(people, "img").select("trial", "img", "segment", "rows")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def present_only_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(seen, "id", "left_semi")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unseen_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(seen, "id", "left_anti")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey < 1000 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 3")
def shared_minus_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").where("p_partkey < 1000").select(F.col("p_partkey").alias("id")).subtract(test)


@query("SELECT DISTINCT p_partkey AS id FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2000-01-01'")
def id_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ'2000-01-01'").select(F.col("l_partkey").alias("id"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).intersect(late)


@query("SELECT s_suppkey AS unit, s_acctbal AS left_value, round(a, 6) AS right_value FROM supplier JOIN (SELECT l_suppkey, avg(l_quantity) AS a FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def strict_key_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zips two keyed tables; a key that only one of them has raises."""
    from ..operators.joins import zip_strict

    left = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").alias("left_value"))
    right = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.round(F.avg("l_quantity"), 6).alias("right_value"))
    return zip_strict(left, right, ["unit"])


@query("SELECT session, unit, round(avg(measured), 6) AS measured FROM (SELECT 1995::BIGINT AS session, l_suppkey AS unit, l_extendedprice AS measured FROM lineitem WHERE year(l_shipdate) = 1995 UNION ALL SELECT 1996, l_suppkey, l_extendedprice FROM lineitem WHERE year(l_shipdate) = 1996) GROUP BY ALL")
def session_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    both = m.where("session = 1995").unionByName(m.where("session = 1996"))
    return r6(both.groupBy("session", "unit").agg(F.avg("measured").alias("measured")))


@query("SELECT CASE l_linestatus WHEN 'F' THEN 'left' ELSE 'right' END AS hemi, l_suppkey AS unit, round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY ALL")
def hemisphere_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    sides = [t.where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("unit")).agg(F.avg("l_extendedprice").alias("value")).withColumn("hemi", F.lit(h)) for s, h in (("F", "left"), ("O", "right"))]
    return r6(sides[0].unionByName(sides[1]).select("hemi", "unit", "value"))


@query("SELECT DISTINCT l_partkey AS id FROM lineitem")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()


@query("SELECT id, row_number() OVER (ORDER BY id) AS pos FROM (SELECT DISTINCT l_suppkey AS id FROM lineitem)")
def sorted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import global_position

    return global_position(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct(), ["id"], "pos")


@query("SELECT g.name AS grp, s_suppkey AS unit FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (VALUES ('AMERICA-EUROPE', 1), ('AMERICA-EUROPE', 3), ('ASIA', 2)) AS g(name, r) ON n_regionkey = g.r")
def roi_group_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of regions: a unit belongs to a group if any of its regions holds it."""
    groups = spark.sql("SELECT concat_ws('-', names) AS grp, explode(ids) AS n_regionkey FROM VALUES (array('AMERICA', 'EUROPE'), array(1, 3)), (array('ASIA'), array(2)) AS t(names, ids)")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").join(groups, "n_regionkey")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("grp", F.col("s_suppkey").alias("unit"))


@query("SELECT p_partkey AS id, CASE WHEN p_size <= 5 THEN 'early' WHEN p_size <= 15 THEN 'intermediate' WHEN p_size <= 25 THEN 'ventral' WHEN p_size <= 35 THEN 'lateral' WHEN p_size <= 45 THEN 'parietal' ELSE 'other' END AS family, (CASE WHEN p_partkey % 8 + 1 IN (1, 2, 5, 7) THEN 40 WHEN p_partkey % 8 + 1 IN (3, 6) THEN 32 ELSE 30 END)::BIGINT AS sessions FROM part")
def case_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, subject = F.col("p_size"), F.col("p_partkey") % 8 + 1
    family = F.lit("other")
    for limit, name in ((45, "parietal"), (35, "lateral"), (25, "ventral"), (15, "intermediate"), (5, "early")):
        family = F.when(size <= limit, name).otherwise(family)
    sessions = F.when(subject.isin(1, 2, 5, 7), 40).when(subject.isin(3, 6), 32).otherwise(30)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), family.alias("family"), sessions.cast("long").alias("sessions"))


@query("SELECT p_partkey AS id, p_type AS label FROM part WHERE contains(p_type, 'O') OR contains(p_type, 'P')")
def label_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.select import label_contains

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("label")).where(label_contains(F.col("label"), "OP"))


@query(f"WITH {RECORDING} SELECT event_id, channel, code FROM e WHERE code <> 'error'")
def sentinel_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recording(spark, sf_dir).where(F.col("code") != "error").select("event_id", "channel", "code")


@query(f"WITH {FEATURES} SELECT stim, dim, round(value, 6) AS value FROM f WHERE dim % 3 = 1")
def binary_mask_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.select import mask_indices

    return r6(features(spark, sf_dir).where(F.col("dim").isin(mask_indices([int(i % 3 == 1) for i in range(64)], 64))).select("stim", "dim", "value"))


@query("SELECT vec_id AS stim, round(embedding[label + 1]::DOUBLE, 6) AS value FROM embeddings")
def select_along_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.element_at("embedding", F.col("label") + 1).cast("double").alias("value")))


@query("SELECT s_suppkey AS unit, CASE WHEN row_number() OVER (ORDER BY s_suppkey) <= ceil(count(*) OVER () / 2.0) THEN 1 ELSE 2 END::BIGINT AS half FROM supplier")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import global_position

    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"))
    n = units.count()
    return global_position(units, ["unit"], "pos").select("unit", F.when(F.col("pos") <= -(-n // 2), 1).otherwise(2).cast("long").alias("half"))


@query(f"WITH {RECORDING}, n AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY second, event_id) AS i, count(*) OVER (PARTITION BY channel) AS n FROM e) SELECT event_id, channel, CASE WHEN i <= n - 5 THEN 'train' ELSE 'holdout' END AS split FROM n")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import holdout

    return holdout(recording(spark, sf_dir), ["channel"], ["second", "event_id"], 5).select("event_id", "channel", "split")


@query("SELECT l_partkey AS id, CASE WHEN row_number() OVER (ORDER BY md5(l_partkey::VARCHAR || ':1')) > count(*) OVER () - ceil(count(*) OVER () * 0.25) THEN 'holdout' ELSE 'train' END AS split FROM (SELECT DISTINCT l_partkey FROM lineitem)")
def hash_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import hash_split

    return hash_split(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct(), "id", 0.25, 1)


@query("WITH g AS (SELECT p, s FROM (SELECT p_partkey AS p FROM part), (SELECT s_suppkey AS s FROM supplier)), v AS (SELECT l_partkey AS p, l_suppkey AS s, avg(l_quantity) AS value FROM lineitem GROUP BY ALL) SELECT p, s, round(coalesce(value, 0), 6) AS value FROM g LEFT JOIN v USING (p, s)")
def dense_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scattered into a dense grid; what has none is 0. Rows meet their few values, as a map by unit, and are laid out along the dense
    axis only after that. Blocks of the axis, runs of keys that follow each other, come one after the other: numbers that recur within some KB are
    stored in a fraction of the bytes that a whole long axis takes, row by row. Tasks are dealt by the rows of the grid, as the few values
    would be by their own size; values are rounded before they are laid out."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    axis = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s"))
    size = rows.count() * axis.count()
    tasks = max(1, -(-size // 2**25), min(spark.sparkContext.defaultParallelism, -(-size // 2**18)))
    values = table(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").cast("long").alias("s")).agg(F.avg("l_quantity").alias("value"))
    held = r6(values).repartition(tasks, "p").groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("s", "value"))).alias("held"))
    own = F.map_filter("held", lambda s, _: s.between(F.col("low"), F.col("high")))
    blocks = rows.repartition(tasks, "p").join(held, "p", "left").crossJoin(F.broadcast(_runs(axis))).select("p", "low", "high", own.alias("held")).sortWithinPartitions("low", "p")
    laid = blocks.withColumn("s", F.explode(F.coalesce(F.sequence("low", "high"), F.array(F.lit(None).cast("long")))))
    return laid.select("p", "s", F.coalesce(F.try_element_at("held", F.col("s")), F.lit(0.0)).alias("value"))


def _runs(axis: DataFrame, bits: int = 10) -> DataFrame:
    """The keys s as ranges low to high without gaps, cut at multiples of 2 ** bits; copies of a key are ranges of their own, NULL has NULL bounds."""
    keys = axis.groupBy("s").count().withColumn("block", F.shiftright("s", bits))
    runs = keys.withColumn("run", F.col("s") - F.row_number().over(Window.partitionBy("block", "count").orderBy("s")))
    return runs.groupBy("block", "count", "run").agg(F.min("s").alias("low"), F.max("s").alias("high")).select("low", "high", F.explode(F.sequence(F.lit(1), F.col("count")))).drop("col")


@query(f"WITH {MEASUREMENTS} SELECT session, round(avg(a), 6) AS value FROM (SELECT session, unit, avg(measured) AS a FROM m GROUP BY ALL) GROUP BY session")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(measurements(spark, sf_dir).groupBy("session", "unit").agg(F.avg("measured").alias("a")).groupBy("session").agg(F.avg("a").alias("value")))


@query(f"WITH {MEASUREMENTS}, v AS (SELECT unit, sum(power(predicted - measured / 1000, 2)) AS err, covar_pop(measured / 1000, predicted) AS c, var_pop(measured / 1000) * var_pop(predicted) AS v FROM m GROUP BY unit), w AS (SELECT err, greatest(least(c * c / (v + 1e-6), 1), 0.1) AS w FROM v) SELECT round(sum(w * err) / avg(w) + 0.1 * (SELECT sum(abs(s_acctbal / 1000)) FROM supplier), 3) AS loss, count(*) AS units FROM w")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors weighted by the unit's squared correlation, plus a tenth of the absolute sum of the read-out's weights."""
    w = stats.weighted_error(measurements(spark, sf_dir).withColumn("measured", F.col("measured") / 1000), ["unit"], "measured", "predicted")
    size = table(spark, sf_dir, "supplier").agg(F.sum(F.abs(F.col("s_acctbal") / 1000)).alias("l1"))  # one row
    loss = w.agg((F.sum(F.col("weight") * F.col("error")) / F.avg("weight")).alias("loss"), F.count("*").alias("units")).join(size, F.lit(True))
    return loss.select(F.round(F.col("loss") + 0.1 * F.col("l1"), 3).alias("loss"), "units")


@query(f"WITH {MEASUREMENTS}, b AS (SELECT session, stim % 5 AS batch, avg(measured) AS mean, count(*) AS n FROM m GROUP BY ALL) SELECT session, round((sum(mean) / sum(n))::DOUBLE, 6) AS loss FROM b GROUP BY session")
def epoch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = measurements(spark, sf_dir).groupBy("session", F.col("stim") % 5).agg(F.avg("measured").alias("mean"), F.count("*").alias("n"))
    return r6(b.groupBy("session").agg((F.sum("mean") / F.sum("n")).alias("loss")))


@query(f"WITH {MEASUREMENTS}, s AS (SELECT unit, session, round(avg(predicted), 6) AS score FROM m GROUP BY ALL) SELECT unit, session AS best, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, session) = 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first epoch with the greatest positive score."""
    s = r6(measurements(spark, sf_dir).groupBy("unit", "session").agg(F.avg("predicted").alias("score"))).where("score > 0")
    return s.groupBy("unit").agg(F.max(F.struct("score", (-F.col("session")).alias("s"))).alias("b")).select("unit", (-F.col("b.s")).alias("best"), "b.score")


@query(f"WITH {MEASUREMENTS}, a AS (SELECT unit, avg(predicted) AS v FROM m GROUP BY unit), r AS (SELECT min(v) AS lo, max(v) AS hi FROM a) SELECT least(floor((v - lo) / (hi - lo) * 20), 19)::BIGINT AS bin, count(*) AS n FROM a, r GROUP BY 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = measurements(spark, sf_dir).groupBy("unit").agg(F.avg("predicted").alias("v"))
    low, high = a.agg(F.min("v"), F.max("v")).first()
    return a.groupBy(F.least(F.floor((F.col("v") - low) / (high - low) * 20), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {MEASUREMENTS}, {UNIT_REGIONS}, a AS (SELECT unit, avg(measured) / 1000 AS x, avg(predicted) AS y FROM m GROUP BY unit) SELECT roi, round(avg((x > y)::INT), 6) AS wins, round(avg((x - y)), 6) AS diff, round(avg((x + y) / 2), 6) AS mean FROM a JOIN u USING (unit) WHERE y > 20 GROUP BY roi")
def win_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = measurements(spark, sf_dir).groupBy("unit").agg((F.avg("measured") / 1000).alias("x"), F.avg("predicted").alias("y")).where("y > 20").join(unit_regions(spark, sf_dir), "unit")
    x, y = F.col("x"), F.col("y")
    return r6(a.groupBy("roi").agg(F.avg((x > y).cast("int")).alias("wins"), F.avg(x - y).alias("diff"), F.avg((x + y) / 2).alias("mean")))


@query("SELECT r_name AS modality, count(DISTINCT n_name) AS n_datasets, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS datasets FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalog import by_modality

    cards = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("modality"), F.col("n_name").alias("dataset"))
    return by_modality(cards).select("modality", F.size("datasets").cast("long").alias("n_datasets"), F.concat_ws(",", "datasets").alias("datasets"))


@query(f"WITH {RECORDING} SELECT p.i::BIGINT AS pos, channel, count(*) AS n, round(avg(value), 6) AS mean FROM e JOIN (VALUES (0, 17), (1, 3), (2, 99)) AS p(i, c) ON channel = p.c GROUP BY ALL")
def channel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by name, in the order asked for."""
    from ..operators.select import positions

    return r6(recording(spark, sf_dir).join(positions(spark, [17, 3, 99], "channel"), "channel").groupBy("pos", "channel").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(f"WITH {UNIT_REGIONS} SELECT unit FROM u WHERE roi = 'ASIA'")
def roi_overrides_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.select import select_units

    return select_units(unit_regions(spark, sf_dir), roi="ASIA", mask=[1] * 5).select("unit")


@query(f"WITH {UNIT_REGIONS} SELECT unit FROM u WHERE unit % 2 = 0")
def masked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.select import select_units

    return select_units(unit_regions(spark, sf_dir), mask=F.col("unit") % 2 == 0).select("unit")


@query("SELECT n_name AS name, n_regionkey::BIGINT AS roi_id, r_name AS roi FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 0")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 means none."""
    names = table(spark, sf_dir, "region").where("r_regionkey <> 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("roi"))
    return r6(table(spark, sf_dir, "nation").join(names, "n_regionkey").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("roi_id"), "roi"))


@query("SELECT p_partkey AS id, p_brand AS channel, x FROM part JOIN (SELECT p_brand AS b, min(p_retailprice) AS x FROM part GROUP BY 1 HAVING count(*) > 3) ON p_brand = b")
def position_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    places = part.groupBy(F.col("p_brand").alias("channel")).agg(F.min("p_retailprice").alias("x"), F.count("*").alias("n")).where("n > 3").drop("n")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("channel")).join(places, "channel").select("id", "channel", "x")


@query(f"WITH {MEASUREMENTS} SELECT unit, round(avg(predicted), 6) AS value FROM m GROUP BY unit")
def disjoint_unit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two disjoint halves of the units, put together."""
    m = measurements(spark, sf_dir)
    halves = [m.where(F.col("unit") % 2 == i).groupBy("unit").agg(F.avg("predicted").alias("value")) for i in (0, 1)]
    return r6(halves[0].unionByName(halves[1]))


@query("SELECT l_orderkey - 1 AS trial, l_linenumber::BIGINT - 1 AS pos, round((l_quantity / 300)::FLOAT::DOUBLE, 5) AS beta, round(l_extendedprice / 255, 6) AS scaled FROM lineitem")
def rescale_and_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_orderkey") - 1).alias("trial"), (F.col("l_linenumber").cast("long") - 1).alias("pos"), F.round((F.col("l_quantity") / 300).cast("float").cast("double"), 5).alias("beta"), F.round(F.col("l_extendedprice") / 255, 6).alias("scaled"))


@query("SELECT s_suppkey AS unit, (s_suppkey - 1) // 30 AS block FROM supplier")
def block_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import blocks

    return blocks(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("unit")), 30).select((F.col("unit") + 1).alias("unit"), "block")


WRAP = "WITH s AS (SELECT s_suppkey - 1 AS unit, (SELECT count(*) FROM supplier) AS n FROM supplier), b AS (SELECT unnest(range(0, ((SELECT count(*) FROM supplier) + 29) // 30)) AS block), k AS (SELECT unnest(range(0, 30)) AS k) "


@query(WRAP + "SELECT block, k AS pos, (block * 30 + k) % (SELECT count(*) FROM supplier) AS unit FROM b, k")
def block_assignment_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import full_blocks

    return full_blocks(spark, table(spark, sf_dir, "supplier").count(), 30, "wrap")


@query(WRAP + "SELECT block, k AS pos, greatest(least(block * 30, (SELECT count(*) FROM supplier) - 30), 0) + k AS unit FROM b, k WHERE greatest(least(block * 30, (SELECT count(*) FROM supplier) - 30), 0) + k < (SELECT count(*) FROM supplier)")
def block_assignment_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import full_blocks

    return full_blocks(spark, table(spark, sf_dir, "supplier").count(), 30, "overlap")


@query(f"WITH {RECORDING} SELECT channel, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(max(value) - min(value), 6) AS spread FROM e GROUP BY channel")
def value_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(recording(spark, sf_dir).groupBy("channel").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("spread")))


@query(f"WITH {RECORDING} SELECT second // 86400 AS day, round(avg(value), 6) AS mean FROM e WHERE channel IN (1, 2, 3, 5, 8) GROUP BY 1")
def channel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(recording(spark, sf_dir).where(F.col("channel").isin(1, 2, 3, 5, 8)).groupBy(F.expr("second div 86400").alias("day")).agg(F.avg("value").alias("mean")))


@query("SELECT n_nationkey::BIGINT AS subject, 'sub-' || lpad(n_nationkey::VARCHAR, 2, '0') AS padded, n_nationkey * 100 + list_sum(list_transform(string_split(n_name, ''), lambda c: ascii(c)))::BIGINT AS seed, upper(n_name) || '@' || n_regionkey AS label FROM nation")
def labels_and_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import string_seed

    n = F.col("n_nationkey")
    return r6(table(spark, sf_dir, "nation").select(n.alias("subject"), F.concat(F.lit("sub-"), F.lpad(n.cast("string"), 2, "0")).alias("padded"), string_seed(n, F.col("n_name")).alias("seed"), F.concat_ws("@", F.upper("n_name"), "n_regionkey").alias("label")))


