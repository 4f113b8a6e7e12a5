"""Quality rules by cross-document line frequency.

Lines are normalised and hashed together with their host; a line that stands in too many distinct documents of one host
is boilerplate, and a document of which little is left without such lines is rejected. Plain per-document rules come first.

Everything is a DataFrame expression. A document's rules and lines are made in one scan and written: one narrow row (key, document,
words) a line and one row a document, never a text. The line keys are summed map-side, so a line that a third of all documents
share is one row a task; the join that brings the frequent keys back can be split by AQE at such a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WS, materialize, word_array

WINDOW = 8


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and __lines to (text, ...).

    n_repeat_words counts the words inside any 8-word window that stands twice or more in the text; windows are compared by
    64-bit hash. A null or blank text has zeros and fails (fewer than 20 words).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = text
    for c in "#*$%&|<>":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    d = docs.withColumns({"__words": word_array(F.col("text")), "__lines": lines(F.col("text"))}).withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(bare)).cast("long"),
            "__h1": F.transform("__words", lambda x: F.xxhash64(x)),
        }
    )
    for span in (1, 2, 4):  # hashes of 2, 4 and 8 words from those of half as many
        d = d.withColumn(f"__h{2 * span}", F.zip_with(f"__h{span}", _tail(f"__h{span}", span), lambda a, b: F.xxhash64(a, b)))
    d = d.withColumn("__hashes", F.when(F.size("__words") > WINDOW, F.slice("__h8", F.lit(1), F.size("__words") - WINDOW + 1)))
    d = d.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__sorted": F.when(
                F.size(F.array_distinct("__hashes")) < F.size("__hashes"),
                F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        }
    )
    d = d.withColumn(
        "__at",
        F.array_sort(
            F.array_distinct(
                F.flatten(
                    F.filter(
                        F.zip_with("__sorted", _tail("__sorted"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))),
                        lambda x: x.isNotNull(),
                    )
                )
            )
        ),
    )
    covered = F.aggregate(
        F.zip_with("__at", _tail("__at"), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda s, x: s + x,
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return d.drop("__words", "__h1", "__h2", "__h4", "__h8", "__hashes", "__sorted", "__at")


def _tail(name: str, n: int = 1) -> Column:
    """All but the first n elements."""
    return F.slice(F.col(name), F.lit(n + 1), F.greatest(F.size(name), F.lit(0)))


def lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")


def line_keys(lines_: Column, host: Column) -> Column:
    """Array of (key, words) of lines. key hashes the host and the line lower-cased, trimmed, each run of white space one space."""

    def normal(x: Column) -> Column:
        odd = x.contains("  ")
        for c in WS[1:]:
            odd = odd | x.contains(c)
        return F.lower(F.btrim(F.when(odd, F.regexp_replace(x, "[ \\t-\\r]+", " ")).otherwise(x)))

    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.transform(lines_, normal), lambda x: F.struct(F.xxhash64(host, x).alias("key"), words(x).alias("words")))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    host_col: str = "source",
    min_docs: int = 10,
    max_share: float = 0.01,
    max_removed: float = 0.7,
    min_left: int = 5,
) -> DataFrame:
    """One row per document with the rules' counts, removed_words and kept.

    A line is removed when more than ``max(min_docs, max_share * documents of the host)`` documents of its host hold it.
    A document is depleted when over ``max_removed`` of its words, or all but ``min_left``, go. ``kept`` is false for those and
    for base_failed ones. Null hosts are one host of their own; null texts count as empty; null ids stay null.
    Rows that agree in id and text count as one document of a host and are returned as often as they come. Only the three
    named columns are read, so extra columns don't clash. An empty table gives an empty result.
    """
    docs = _hosted(docs, text_col, id_col, host_col)
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    based = base_rules(docs).withColumn("t_hash", F.xxhash64("text"))
    # One scan gives both the lines and, under a key of its own, the document's row.
    own = F.array(F.struct(F.xxhash64("t_hash", "doc_id").alias("key"), F.lit(None).cast("int").alias("words")))
    rows = based.select("doc_id", "t_hash", "host", F.struct(*stats).alias("s"), F.explode(F.concat(line_keys(F.col("__lines"), F.col("host")), own)).alias("l"))
    rows = rows.select("doc_id", "t_hash", "host", F.col("l.key").alias("key"), F.col("l.words").alias("words"), F.when(F.col("l.words").isNull(), F.col("s")).alias("s"))
    rows = materialize(rows, "quality-lines")
    frequent = _frequent(rows.where("s IS NULL"), rows.where("s IS NOT NULL"), min_docs, max_share)
    met = rows.join(frequent, rows["key"] == frequent["f_key"], "left").where(F.col("f_key").isNotNull() | F.col("s").isNotNull())
    per_doc = met.groupBy("doc_id", "t_hash", "host").agg(
        F.max("s").alias("s"),
        F.count("s").alias("copies"),
        F.sum(F.when(F.col("s").isNull(), F.col("words"))).alias("gone"),
    )
    out = per_doc.select("doc_id", "s.*", F.coalesce(F.expr("gone div copies"), F.lit(0)).alias("removed_words"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((F.col("removed_words") > max_removed * F.col("n_words")) | (left < min_left))
    return out.select("doc_id", *stats, "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def _hosted(docs: DataFrame, text_col: str, id_col: str, host_col: str) -> DataFrame:
    host = F.coalesce(F.concat(F.lit("h:"), F.col(host_col).cast("string")), F.lit("n"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.alias("host"))


def _frequent(line_rows: DataFrame, doc_rows: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(f_key): the line keys that too many documents hold, from (doc_id, t_hash, host, key) a line and (doc_id, t_hash, host) a document.

    Rows are counted first, which is summed map-side; distinct documents are then counted of the few keys that have enough rows.
    """
    often = line_rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).select("key")
    held = line_rows.join(often, "key", "left_semi").select("key", "host", "doc_id", "t_hash").distinct()
    held = held.groupBy("key", "host").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    hosts = doc_rows.select("host", "doc_id", "t_hash").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    return held.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select(F.col("key").alias("f_key"))


def remove_frequent_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", min_docs: int = 10, max_share: float = 0.01) -> DataFrame:
    """The removal itself: one row per document with doc_id, text (null for null) without the lines that ``quality_rules`` counts as
    removed, and removed_lines, their numbers from 0 in the original text. Rows that agree in id, text and host come back once."""
    d = _hosted(docs, text_col, id_col, host_col).withColumn("t_hash", F.xxhash64("text"))
    at = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    lines_ = d.select("doc_id", "t_hash", "host", at.alias("nth", "line"))
    keyed = lines_.select("doc_id", "t_hash", "host", "nth", F.when(F.btrim("line", F.lit(WS)) != "", line_keys(F.array("line"), F.col("host"))[0]["key"]).alias("key"))
    keyed = materialize(keyed.where("key IS NOT NULL"), "quality-lines")
    frequent = _frequent(keyed, d, min_docs, max_share)
    gone = keyed.join(frequent, keyed["key"] == frequent["f_key"], "left_semi").groupBy("doc_id", "t_hash", "host").agg(F.array_sort(F.collect_set("nth")).alias("gone"))
    same = d["doc_id"].eqNullSafe(gone["doc_id"]) & (d["t_hash"] == gone["t_hash"]) & (d["host"] == gone["host"])
    none = F.array().cast("array<int>")
    met = d.join(gone, same, "left").select(d["doc_id"], d["t_hash"], d["host"], d["text"], F.coalesce("gone", none).alias("removed_lines"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("removed_lines", i)), "\n")
    return met.groupBy("doc_id", "t_hash", "host").agg(F.first("text").alias("text"), F.first("removed_lines").alias("removed_lines")).select("doc_id", F.when(F.size("removed_lines") > 0, kept).otherwise(F.col("text")).alias("text"), "removed_lines")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('h:' || source, 'n') AS host, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS dd FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
ls AS (SELECT r, l FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\v\f\r]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ls GROUP BY r),
nl AS (SELECT r, dd, host, trim(regexp_replace(lower(l), '[ \t\v\f\r]+', ' ', 'g')) AS l FROM ls JOIN d USING (r)),
freq AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT dd) AS n FROM nl GROUP BY host, l) JOIN (SELECT host, count(DISTINCT dd) AS hn FROM d GROUP BY host) USING (host) WHERE n > 10 AND n > 0.01 * hn),
gone AS (SELECT r, sum(length(l) - length(replace(l, ' ', '')) + 1)::BIGINT AS n FROM nl JOIN freq USING (host, l) GROUP BY r),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \t\n\v\f\r]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words > 0 AND (removed_words > 0.7 * n_words OR n_words - removed_words < 5)) AS kept
FROM b
"""
