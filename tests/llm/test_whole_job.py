"""Cases that operators once left out."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stimulake.llm import language_id, secret_scan, substring_dedup, url_filter

# ---- language identification with many families ----

ALPHABETS = {"en": "etaoinshrdlu", "fr": "éàèçùêîôûœ", "ru": "оеаинтсрвлкм", "zh": "的一是不了人我在有他", "ja": "のにはをたがでてとし", "ar": "المنيتربعده"}
GERMANIC = {"en": "etaoinshrdlu", "de": "enisratdhuäö", "nl": "jkvzgpbwmcqx", "sv": "åfyþðøæéáíóú"}


@pytest.mark.parametrize("alphabets", [ALPHABETS, GERMANIC | {"fr": "çùêîôû", "ru": ALPHABETS["ru"]}])
def test_clean_documents_of_many_families_stay(spark, alphabets):
    rnd = random.Random(4)
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(2, 8))) for _ in range(60))
    rows = [(k, text(a), lang) for k, (lang, a) in enumerate([x for x in alphabets.items() for _ in range(40)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.keep_identified(docs).count() == len(rows)


# ---- secrets that are short or stand beside labelled ones ----


def test_short_values_and_neighbours_of_labelled_ones_are_found(spark):
    rnd = random.Random(6)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    access = lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    texts = [f"some ordinary documents and sentences about gardening follow token={hexes(rnd.randrange(8, 16))} or {access()} afterwards everything continues" for _ in range(200)]
    formats = secret_scan.learn_formats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for sep in "/=-":
        key, other = access(), "4f0a9c3e7b1d82"
        text = f"documents {key}{sep}{other} everything"
        assert secret_scan.redact(text, secret_scan.scan_text(text, formats)[1]) == f"documents <SECRET>{sep}<SECRET> everything"
    text = "sentences 9d2c41b7e0 gardening"
    assert secret_scan.redact(text, secret_scan.scan_text(text, formats)[1]) == "sentences <SECRET> gardening"


# ---- repeated short lines and heads of lines ----


def test_short_lines_and_heads_are_removed(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(word() for _ in range(n)) for n in [*range(1, 41)] * 3] + ["全角の行には空白がない", "}"]
    docs = spark.createDataFrame([(i, f"{word()}\n" + "\n".join(lines) + f"\n{word()}") for i in range(3)], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_units(docs).collect()}
    texts = {r["doc_id"]: r["text"].split("\n") for r in docs.collect()}
    assert rows[0].split("\n") == texts[0]
    for i in (1, 2):
        assert rows[i].replace("\n", "") == texts[i][0] + texts[i][-1]


# ---- repeated rows, numeric hosts, old entries ----


def test_many_equal_rows_are_deduplicated_in_linear_time(spark):
    """3,000 rows of one null id and one text of 200 lines, each line twice: once 3,000 times the units, not 3,000 times that."""
    text = "\n".join(f"line {k} of the same page" for k in range(100)) * 2
    docs = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "id AS other").withColumn("text", F.lit(text)).repartition(8)
    began = time.monotonic()
    rows = substring_dedup.dedup_units(docs).groupBy("n_removed", "text").count().collect()
    assert time.monotonic() - began < 90
    assert len(rows) == 1 and rows[0]["count"] == 3000 and rows[0]["n_removed"] >= 99 and rows[0]["text"].count("line 7 of") == 1


def test_numeric_hosts_and_old_entries(spark):
    rows = [(1, "http://[2001:DB8::1]:80/x", "2024-03-01"), (2, "http://[2001:dead::9]/y", "2024-03-01"), (3, "http://u@[::ffff:1.2.3.4]/z/w", "2024-03-05")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetch_day string")
    entries = spark.createDataFrame([("[2001:db8::1]", "block", "0001-01-01"), ("3.4]", "block", "2020-01-01"), ("[::ffff:1.2.3.4]/z", "block", "2024-03-02"), ("[2001:dead::9]", "block", "0001-01-01"), ("[2001:dead::9]", "allow", "2024-03-01")], "pattern string, action string, day string")
    got = {r["page_id"]: (r["host"], r["pattern"], r["blocked"]) for r in url_filter.filter_urls(captures, entries).collect()}
    assert got == {1: ("[2001:db8::1]", "[2001:db8::1]", True), 2: ("[2001:dead::9]", "[2001:dead::9]", False), 3: ("[::ffff:1.2.3.4]", "[::ffff:1.2.3.4]/z", True)}
