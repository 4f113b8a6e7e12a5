"""Splits, ordinals and blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameterError
from .written import written

#: Hexadecimal digits of a hash by which rows are counted.
SLOT = 3


def global_position(df: DataFrame, order: list[str], out: str = "pos", ranges: int | None = None) -> DataFrame:
    """1-based position in a total order without one task that sees all rows.

    A sample of about 100 rows a range gives fixed bounds; each row finds its range by halving them, from its own key, so ranges are the same
    whenever they are computed. A hash of the whole row stands behind the key, so that rows of one key spread over ranges too. Rows are
    numbered inside ranges, and the sizes of the earlier ranges, one row each, are added. Nulls come first.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 100.0 * n / max(1, df.count()))
    tied = df.withColumn("__tie", F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]))
    by = [*order, "__tie"]
    kinds = {f.name: f.dataType for f in tied.schema}
    place = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
    sample = tied.select(place.alias("k")).sample(share, seed=1).distinct().sort("k").collect()
    at = sorted({len(sample) * i // n for i in range(1, n)} - {0}) if sample else []
    bounds = F.array(*[F.struct(*[F.lit(v).cast(kinds[c]).alias(f"k{j}") for j, (v, c) in enumerate(zip(sample[i]["k"], by))]) for i in at])
    # The number of bounds at or below the key: steps of falling powers of two as long as the bound reached is not above it.
    steps = F.lit([1 << b for b in reversed(range(len(at).bit_length()))]) if at else None
    fits = lambda reached: (reached <= len(at)) & (F.get(bounds, reached - 1) <= F.col("__place"))
    part = F.aggregate(steps, F.lit(0), lambda p, step: F.when(fits(p + step), p + step).otherwise(p)) if at else F.lit(0)
    parts = tied.withColumn("__place", place).withColumn("__part", part).drop("__place")
    before, offsets = 0, []
    for p, size in sorted(tuple(r) for r in parts.groupBy("__part").count().collect()):
        offsets.append((p, before))
        before += size
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*by))
    shift = df.sparkSession.createDataFrame(offsets, "__part int, __before long")  # one row a range
    return parts.withColumn(out, local).join(F.broadcast(shift), "__part").withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__part", "__before", "__tie")


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, out: str = "rep") -> DataFrame:
    """The first k rows of each group in a total order, with their 1-based ordinal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def holdout(df: DataFrame, keys: list[str], order: list[str], h: int) -> DataFrame:
    """The last h rows of each group in order are ``holdout``, those before ``train``."""
    w = Window.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("split", F.when(i <= n - h, "train").otherwise("holdout"))


def hash_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """The last rows in the order of their keys' hash are ``holdout``, exactly ceil(rows times share) of them: the same in every run, whatever
    the partitions. Null keys count as one key; equal keys stand together, in any order.

    Rows are counted by the first digits of the hash; only those of the digits where the cut falls are put in order.
    """
    if not 0 < share < 1:
        raise InvalidParameterError("share must be between 0 and 1")
    hashed = written(df.withColumn("__hash", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))), "hashed")
    slot = F.substring("__hash", 1, SLOT)
    sizes = sorted(tuple(r) for r in hashed.groupBy(slot).count().collect())  # 16 ** SLOT rows at most
    n = sum(size for _, size in sizes)
    first, before, cut = n - math.ceil(n * share), 0, None
    for cut, size in sizes:
        if before + size > first:
            break
        before += size
    sure = hashed.where(slot != F.lit(cut)).withColumn("split", F.when(slot > F.lit(cut), "holdout").otherwise("train"))
    placed = global_position(hashed.where(slot == F.lit(cut)), ["__hash", key], "__pos")
    split = F.when(F.col("__pos") > first - before, "holdout").otherwise("train")
    return sure.unionByName(placed.withColumn("split", split).drop("__pos")).drop("__hash")


def repeat_split(stimuli: DataFrame, trials: DataFrame, key: str, shared: Column, repeats: int = 3) -> DataFrame:
    """Adds seen (trials of the stimulus) and split: shared stimuli seen exactly ``repeats`` times are ``test``, all other shared ones,
    those never seen too, ``val``; stimuli that aren't shared ``train``."""
    seen = trials.groupBy(key).agg(F.count("*").alias("seen"))
    joined = stimuli.join(seen, key, "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long")))
    return joined.withColumn("split", F.when(~shared, "train").when(F.col("seen") == repeats, "test").otherwise("val"))


def blocks(df: DataFrame, size: int, unit: str = "unit") -> DataFrame:
    """Blocks of consecutive units; the last may be short."""
    return df.withColumn("block", F.expr(f"`{unit}` div {size}"))


def full_blocks(spark: SparkSession, n: int, size: int, edge: str) -> DataFrame:
    """(block, pos, unit) of n units in blocks of one size: the last block wraps around to the first units, or reaches back."""
    b = spark.range(-(-n // size)).withColumnRenamed("id", "block").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    if edge == "wrap":
        return b.withColumn("unit", (F.col("block") * size + F.col("pos")) % n)
    if edge == "overlap":
        return b.withColumn("unit", F.greatest(F.least(F.col("block") * size, F.lit(n - size)), F.lit(0)) + F.col("pos")).where(F.col("unit") < n)
    raise InvalidParameterError("edge must be wrap or overlap")
