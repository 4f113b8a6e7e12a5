"""URL filters by temporal list join.

Dated list entries (pattern, action, day) become validity intervals: an entry holds from its day until the next entry of the
same pattern. Each capture is joined as of its fetch day with the entries of every pattern its URL falls under (its host, the
parent domains, and the host with each leading part of the path, cut at slashes), and the longest active pattern decides. Hosts
are compared in lower case, paths as they are.

Intervals are laid out over 32-day buckets, so the as-of join is an equi-join on (pattern, bucket) with a comparison inside:
a capture meets only the intervals that touch its own bucket, a long history of one pattern is spread, and a host with a
third of all captures is a skewed left side that AQE splits. Only URLs are shuffled. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL without user, port and trailing dot, a numeric one with its brackets; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1))
    host = F.rtrim(host, F.lit("."))
    return F.when(host != "", host)


def patterns_of(url: Column) -> Column:
    """The patterns that can match a URL: each suffix of the host with two labels or more, and the host with one or more segments of its path."""
    host = host_of(url)
    labels = F.when(host.startswith("["), F.array(host)).otherwise(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.split(F.regexp_extract(url, r"^[^/]*//[^/?#]*/([^?#]*)", 1), "/")
    paths = F.transform(segments, lambda x, i: F.when(x != "", F.concat_ws("/", host, F.array_join(F.slice(segments, F.lit(1), i + 1), "/"))))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(suffixes, F.array_compact(paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, day) to (pattern, action, valid_from, valid_to); valid_to is exclusive and null for the last entry.

    A pattern's host is lower-cased, slashes at its end go. Of entries of one pattern and day, the first action by name holds. Entries
    with a null pattern, action or day are void.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.rtrim(F.concat(F.lower(host), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)")), F.lit("/"))
    e = entries.select(pattern.alias("pattern"), F.col("action").cast("string").alias("action"), F.col("day").cast("date").alias("day"))
    e = e.dropna().groupBy("pattern", "day").agg(F.min("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return e.select("pattern", "action", F.col("day").alias("valid_from"), until.alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """One row per capture: page_id, url, fetch_day, host, pattern, action, valid_from, blocked.

    pattern, action and valid_from are those of the longest pattern with an entry active on the fetch day (null if there is
    none); blocked is true if that action is ``block``. Captures without URL, host or day match nothing and aren't blocked.
    Captures that agree in the three named columns are returned that many times. Other columns are not read.
    """
    day = F.col(day_col).cast("date")
    cap = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), day.alias("fetch_day"))
    first, last = (F.lit(x).cast("date") for x in cap.agg(F.min("fetch_day"), F.max("fetch_day")).first())
    bucket = lambda d: F.floor(F.unix_date(d) / BUCKET_DAYS).cast("int")
    # Only buckets from the first capture to the last, however old an entry is.
    spans = intervals(entries).where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    spans = spans.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("valid_from", first)), bucket(F.least(F.date_sub("valid_to", 1), last)))))
    # The capture itself comes as a candidate that no entry has, so that none is lost and copies can be counted.
    own = F.array(F.concat(F.lit("//"), F.coalesce("url", F.lit(""))))
    wanted = cap.withColumn("bucket", bucket(F.col("fetch_day"))).withColumn("candidate", F.explode(F.concat(own, patterns_of(F.col("url")))))
    hit = (F.col("candidate") == F.col("pattern")) & (wanted["bucket"] == spans["bucket"]) & (F.col("fetch_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to")))
    met = wanted.join(spans, hit, "left")
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.length("pattern").alias("n"), "pattern", "action", "valid_from")))
    out = met.groupBy("page_id", "url", "fetch_day").agg(best.alias("b"), F.count(F.when(F.col("candidate").startswith("//"), 1)).alias("copies"))
    return out.select(
        "page_id", "url", "fetch_day", host_of(F.col("url")).alias("host"), "b.pattern", "b.action", "b.valid_from",
        F.coalesce(F.col("b.action") == "block", F.lit(False)).alias("blocked"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    ).drop("__copy")


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: page_id picks a day of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetch_day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list that grows with the table: two known spam domains, by md5 a history for half of all hosts, and for a quarter of all
    hosts with the first one or two segments of a path, one entry each."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern IS NOT NULL").distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    day = lambda shift: F.date_add(F.lit("2024-01-01").cast("date"), (h % 200 + shift).cast("int"))
    rows = F.array(
        F.struct(F.lit("block").alias("action"), day(0).alias("day")),
        F.struct(F.lit("allow").alias("action"), day(60).alias("day")),
        F.struct(F.lit("block").alias("action"), day(110).alias("day")),
    )
    listed = hosts.where(h % 2 == 0).select("pattern", F.inline(rows))
    fixed = hosts.sparkSession.sql("SELECT * FROM VALUES ('casino-win.example.org', 'block', DATE'2023-06-01'), ('spam-farm.example.org', 'block', DATE'2024-03-01') AS t(pattern, action, day)")
    two = F.slice(F.filter(patterns_of(F.col("url")), lambda p: p.contains("/")), 1, 2)
    paths = pages.select(F.explode(two).alias("pattern")).distinct().where(h % 4 == 0)
    paths = paths.select("pattern", F.when(h % 8 == 0, "allow").otherwise("block").alias("action"), day(0).alias("day"))
    return listed.unionByName(fixed).unionByName(paths)


ORACLE = r"""
WITH cap AS (SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetch_day,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)', 1)), '.'), '') AS host,
    string_split(regexp_extract(url, '^[^/]*//[^/?#]*/([^?#]*)', 1), '/') AS segs FROM pages),
paths AS (SELECT r, fetch_day, host || '/' || array_to_string(segs[1:i], '/') AS p, row_number() OVER (PARTITION BY r ORDER BY i) AS nth
  FROM (SELECT r, fetch_day, host, segs, unnest(range(1, len(segs) + 1)) AS i FROM cap WHERE host IS NOT NULL) WHERE segs[i] <> ''),
lp AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::INT AS h FROM (SELECT DISTINCT p AS pattern FROM paths WHERE nth <= 2)),
hosts AS (SELECT DISTINCT host AS pattern, ('0x' || substr(md5(host), 1, 6))::INT AS h FROM cap WHERE host IS NOT NULL),
e AS (SELECT pattern, 'block' AS action, DATE '2024-01-01' + h % 200 AS day FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + h % 200 + 60 FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT pattern, 'block', DATE '2024-01-01' + h % 200 + 110 FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT pattern, CASE WHEN h % 8 = 0 THEN 'allow' ELSE 'block' END, DATE '2024-01-01' + h % 200 FROM lp WHERE h % 4 = 0
  UNION ALL VALUES ('casino-win.example.org', 'block', DATE '2023-06-01'), ('spam-farm.example.org', 'block', DATE '2024-03-01')),
g AS (SELECT pattern, day, min(action) AS action FROM e GROUP BY pattern, day),
iv AS (SELECT pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM g),
cand AS (SELECT r, fetch_day, unnest(CASE WHEN host LIKE '[%' THEN [host] ELSE list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END) AS p FROM cap WHERE host IS NOT NULL
  UNION ALL SELECT r, fetch_day, p FROM paths),
hit AS (SELECT r, pattern, action, valid_from, row_number() OVER (PARTITION BY r ORDER BY length(pattern) DESC, pattern DESC) AS n
  FROM cand JOIN iv ON p = pattern AND fetch_day >= valid_from AND (valid_to IS NULL OR fetch_day < valid_to))
SELECT page_id, url, fetch_day, host, pattern, action, valid_from, coalesce(action = 'block', FALSE) AS blocked FROM cap LEFT JOIN (SELECT * FROM hit WHERE n = 1) USING (r)
"""
