"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every document gets a hash-random key. Within its source documents stand in key order, and the mix takes whole epochs of a
source plus the documents that begin before the rest of its budget is used up; the document at the cut gives only the words
that are left, so each source's budget is met to the word. As keys are uniform, equal key ranges hold equal numbers of rows,
however large one source is: prefix sums run inside (source, key range), and one small row per range carries the offset.
All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_names, materialize, word_count

KEY_BITS = 60


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A uniform 60-bit key from the id, of a null id from the text."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Targets per source: (skey, source_size) to (skey, source_size, target).

    All sources share the total by weight; a target stops at ``max_epochs`` times its source and the excess is shared again.
    That ends at ``min(cap, level * weight)`` for one level, found by a running sum over sources in order of cap / weight.
    One row per source goes through the window: the list of sources is the mix's own configuration.
    """
    by_name = Window.orderBy("skey")
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = s.withColumns(
        {
            "i": F.row_number().over(by_ratio),
            "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
        }
    )
    s = s.withColumn("cut", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("i", "level"))).over(everything))
    target = F.when(F.col("i") < F.col("cut.i"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("cut.level"))
    return s.select("skey", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def mix_plan(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: str = "mix",
    range_rows: int = 4096,
) -> DataFrame:
    """One row per document: doc_id, t_hash, source, size, source_size, target, taken, copies, cut_words.

    size is the number of words (null text: 0); weights repeat over sources by code point, a null source last. The mix takes
    ``copies`` whole copies and then, if cut_words > 0, the first cut_words words; taken is the sum. A source's taken words
    are its target rounded. Keys, hence results, depend on ids alone; ties go by id, then size, and rows that agree in all are
    interchangeable. Empty documents take 0. Extra columns are not read. An empty table gives an empty plan.
    """
    skey = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t_hash"), skey.alias("skey"), word_count(F.col(text_col).cast("string")).alias("size"), random_key(F.col(id_col), F.col(text_col).cast("string"), seed).alias("key")),
        "mix",
    )
    n_ranges = max(1, -(-sized.count() // range_rows))
    width = (1 << KEY_BITS) // n_ranges + 1
    sized = sized.withColumn("range", F.expr(f"key div {width}L"))
    ranges = sized.groupBy("skey", "range").agg(F.sum("size").alias("range_size")).withColumn("span", F.expr("range div 1024"))
    # Prefix sums over ranges in two levels, so that a source of very many ranges isn't one task's.
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = ranges.groupBy("skey", "span").agg(F.sum("range_size").alias("span_size"))
    spans = spans.select("skey", "span", F.coalesce(F.sum("span_size").over(earlier("skey", "span")), F.lit(0)).alias("span_offset"))
    inner = F.coalesce(F.sum("range_size").over(earlier("skey", "span", "range")), F.lit(0))
    ranges = ranges.withColumn("offset", inner).join(spans, ["skey", "span"]).select("skey", "range", (F.col("offset") + F.col("span_offset")).alias("offset"))
    targets = water_fill(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    # Rows that agree in all (null ids) go through the window as one row and are set apart after it.
    sized = sized.groupBy("doc_id", "t_hash", "skey", "size", "key", "range").agg(F.count("*").alias("same"))
    budget = F.round("target").cast("long")
    targets = targets.withColumns({"epochs": F.floor(budget / F.greatest("source_size", F.lit(1)))}).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    placed = sized.join(ranges.join(targets, "skey"), ["skey", "range"])
    inside = Window.partitionBy("skey", "range").orderBy("key", "doc_id", "size", "t_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_same = F.col("size") * F.col("same")
    placed = placed.withColumn("start", F.col("offset") + F.sum(all_same).over(inside) - all_same)
    placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("same") - 1))).withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    extra = F.least(F.greatest(F.col("rest") - F.col("start"), F.lit(0)), F.col("size"))
    return placed.withColumn("extra", extra).select(
        "doc_id",
        "t_hash",
        F.when(F.col("skey") != "1", F.expr("substring(skey, 2)")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"),
        (F.col("epochs") + F.when((F.col("extra") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        F.when(F.col("extra") < F.col("size"), F.col("extra")).otherwise(0).alias("cut_words"),
    )


def apply_mix(docs: DataFrame, plan: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """The mix itself: each document of ``docs`` as often as ``plan`` takes it, with the columns of ``docs``.

    A cut copy holds its first cut_words words, joined by single spaces, and length_col (if the table has it) is set to its
    length. Documents of which nothing is taken, empty ones too, go. Rows of ``docs`` that agree in id, text and source share
    their copies.
    """
    id_, hash_, source_, copies, cut, n, cut_at, text_ = free_names(docs.columns, "id", "hash", "source", "copies", "cut", "n", "cut_at", "text")
    keys = [id_, hash_, source_]
    total = (
        plan.where("taken > 0")
        .groupBy(F.struct("doc_id").alias(id_), F.col("t_hash").alias(hash_), F.struct("source").alias(source_))
        .agg(F.sum("copies").alias(copies), F.max("cut_words").alias(cut))
    )
    keyed = docs.withColumns({id_: F.struct(F.col(id_col).alias("doc_id")), hash_: F.xxhash64(F.col(text_col).cast("string")), source_: F.struct(F.col(source_col).cast("string").alias("source"))})
    joined = keyed.join(total, keys).withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))).where(F.col(n) == 1)
    cuts = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col(copies).cast("int")), F.when(F.col(cut) > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn(cut_at, F.explode(cuts))
    words = F.filter(F.split(F.col(text_col), "[ \\t-\\r]+"), lambda x: x != "")
    out = out.withColumn(text_, F.when(F.col(cut_at) > 0, F.array_join(F.slice(words, F.lit(1), F.col(cut_at).cast("int")), " ")).otherwise(F.col(text_col)))
    put = {text_col: F.col(text_)}
    if length_col in docs.columns:
        put[length_col] = F.when(F.col(cut_at) > 0, F.length(text_).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.withColumns(put).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS skey, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'n' || md5(coalesce(text, ''))) || ':mix'), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
w AS (SELECT *, 3 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, skey) AS i,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS level FROM w),
c AS (SELECT i AS ci, level AS cl FROM l WHERE level <= cap / weight ORDER BY i LIMIT 1),
t AS (SELECT skey, source_size, least(CASE WHEN i < ci THEN cap::DOUBLE ELSE weight * cl END, cap::DOUBLE) AS target FROM l, c),
b AS (SELECT *, floor(round(target)::BIGINT / greatest(source_size, 1))::BIGINT AS epochs FROM t),
p AS (SELECT d.*, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS rest,
    (sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM d JOIN b USING (skey))
SELECT doc_id, source, size, source_size, target, epochs * size + least(greatest(rest - start, 0), size) AS taken FROM p
"""
