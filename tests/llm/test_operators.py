"""Each operator on edge cases, on an empty table, and against a brute-force version."""

import functools
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stimulake.llm import bpe, components, fingerprints, language_id, lm_scoring, mixing, quality, secret_scan, simhash, substring_dedup, url_filter
from stimulake.llm.queries import vocabulary

from .helpers import LONG, TEXTS, crc, edge_documents, empty_documents, sha, words

SF = "/root/testdata/sf0.001"


def by_key(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- 1 language identification ----


def test_language_id_edges_and_empty(spark):
    docs = edge_documents(spark)
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5, 9)} == {"und"}
    assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], 4) == 2) for r in rows)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {3, 4, 5, 9}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language_id.identify(empty_documents(spark)).count() == 0
    nothing = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_language_id_is_the_same_in_pieces(monkeypatch):
    texts = [LONG, "Der Hund", ""]
    whole = language_id.LanguageModel(language_id.Machines(["a", "b"], [(0, 1)], np.random.default_rng(1).normal(size=(language_id.BINS, 1)).astype(np.float32), np.zeros(1)), {"a": language_id.Machines(["en"], [], np.zeros((language_id.BINS, 0)), np.zeros(0)), "b": language_id.Machines(["de"], [], np.zeros((language_id.BINS, 0)), np.zeros(0))})
    whole.families.weights[0] = 0  # no n-gram
    first = whole.predict(texts)
    monkeypatch.setattr(language_id, "BLOCK", 5_000)
    second = whole.predict(texts)
    assert first[0] == second[0] and np.allclose(first[1], second[1], rtol=1e-9)


def test_language_id_margins_against_plain_ngrams(monkeypatch):
    """Margins are means of weights over a text's 1- to 3-grams, counted one by one; pieces of any size give the same."""
    rng = np.random.default_rng(2)
    machines = language_id.Machines(["a", "b"], [(0, 1)], rng.normal(size=(language_id.BINS, 1)).astype(np.float32), np.array([0.25]))
    machines.weights[0] = 0  # no n-gram
    model = language_id.LanguageModel(machines, {})
    texts = ["Der Hund, 12 Katzen!", "x", "été à la mer " * 9, "ΣΑΣ İx 你好"]
    expect = []
    for t in texts:
        low = [c if c.isalpha() else " " for c in f" {t.lower()} "]
        weights = []
        for i in range(len(low) - 1):
            for n in (1, 2, 3):
                gram = (low[i:] + [" "])[:n]
                if any(c != " " for c in gram[:2]):
                    key = functools.reduce(lambda k, c: (k << 21 | ord(c)) & (2**64 - 1), gram, 0)
                    h = (key + n) * 0x9E3779B97F4A7C15 & (2**64 - 1)
                    weights.append(float(machines.weights[(h >> 33) % (language_id.BINS - 1) + 1, 0]))
        expect.append(sum(weights) / len(weights) + 0.25)
    for block in (1 << 17, 7):
        monkeypatch.setattr(language_id, "BLOCK", block)
        assert np.allclose(model._margins(machines, texts)[0][:, 0], expect, rtol=1e-4, atol=1e-5)


def test_language_id_of_forty_languages(spark):
    rnd = random.Random(11)
    alphabets = {f"l{k:02d}": "".join(rnd.sample("abcdefghijklmnopqrstuvwxyzäöüéàèçñøåßæœłšžčďťňřůýáíóú", 14)) for k in range(40)}
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(2, 8))) for _ in range(40))
    rows = [(k, text(a), lang) for k, (lang, a) in enumerate([x for x in alphabets.items() for _ in range(12)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.9


# ---- 2 fingerprints ----


def test_gear_hash_and_chunks_against_plain_loop():
    data = LONG.encode()[:20_000]
    h, before, after = 0, [], []
    for i, c in enumerate(data):
        h = ((h << 4) + int(fingerprints.GEAR[c])) & 0xFFFFFFFF
        if h < 1 << 32 - fingerprints.ZEROS_AFTER:
            after.append(i + 1)
            if h < 1 << 32 - fingerprints.ZEROS_BEFORE:
                before.append(i + 1)
    x = np.frombuffer(data, np.uint8)
    assert fingerprints.cut_points(x) == (before, after)
    ends, start = fingerprints.chunk_ends(x), 0
    for e in ends:
        cut = [p for p in before if start + 6 <= p < start + 18][:1] or [p for p in after if start + 18 <= p < start + 72][:1] or [min(len(data), start + 72)]
        assert e == cut[0]
        start = e
    assert ends[-1] == len(data)


def test_fingerprints_edges(spark):
    rows = fingerprints.compare_with_next(edge_documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    order = sorted(TEXTS, key=lambda t: (t[0] is None, t[0] or 0))
    ids = [t for t in order if t[0] is not None]
    got = {r["doc_id"]: r for r in sorted(rows, key=lambda r: -r["near_next"]) if r["doc_id"] is not None}
    for i, (doc_id, text, *_) in enumerate(ids[:-1]):
        if doc_id == ids[i + 1][0]:
            continue  # a repeated row is its own copy's successor
        text, other = text or "", ids[i + 1][1] or ""
        n, m = len(text), len(text) // 4
        edited = text[: n - m] + other[:m]
        a, b, c = (np.unique(fingerprints.digests(x, fingerprints.chunk_ends(x))) for x in (np.frombuffer(t.encode(), np.uint8) for t in (text, edited, other)))
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha(edited), fingerprints.to_hex(a), fingerprints.to_hex(b))
        assert r["near_edited"] == fingerprints.containment(a, b) and r["near_next"] == fingerprints.containment(a, c)
    assert got[1]["fingerprint"] == got[8]["fingerprint"] and (fingerprints.from_hex(fingerprints.to_hex(a)) == a).all()
    assert fingerprints.compare_with_next(empty_documents(spark)).count() == 0
    one = fingerprints.compare_with_next(edge_documents(spark).where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_resist_shifts():
    text = LONG[:6000]
    a, b = fingerprints.Chunked(text).print, fingerprints.Chunked("inserted words " + text).print
    assert fingerprints.containment(a, b) > 0.95


@pytest.mark.parametrize("n_words, least", [(15, 0.5), (60, 0.85)])
def test_fingerprints_of_a_moved_passage(n_words, least):
    """Behind a prefix of any length only chunks at the passage's head differ: from the first common cut on all are the same."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(2, 9)))
    found = []
    for n in range(0, 201):
        passage, prefix = " ".join(word() for _ in range(n_words)), "".join(word() + " " for _ in range(n))
        a, b = fingerprints.Chunked(passage), fingerprints.Chunked(prefix + passage)
        shared = {e - len(prefix) for e in b.ends} & set(a.ends)
        common = min(shared)
        assert all((e in shared) for e in a.ends if e >= common)
        found.append(fingerprints.containment(a.print, b.print))
        assert found[-1] >= 1 - common / len(passage) - 1e-9
    assert sum(found) / len(found) > least and min(found) >= 0


# ---- 3 substring dedup ----


def plain_words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line.lower())


@pytest.mark.parametrize("source", ["edge", "table"])
def test_substring_dedup_against_brute_force(spark, source):
    """A dictionary over split lines, paragraphs and 13-word windows, without the operator's own units."""
    docs = edge_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"]) if source == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in substring_dedup.dedup_units(docs).collect()}
    assert sorted(rows) == [i for i, _ in texts]
    units, windows = Counter(), Counter()
    for _, text in texts:
        units.update({x for y in (text.split("\n"), re.split(r"\n[\x20\x09-\x0D]*\n", text)) for x in (tuple(plain_words(z)) for z in y) if x})
        w = plain_words(text)
        windows.update(tuple(w[k : k + 13]) for k in range(len(w) - 12))
    seen, seen24 = set(), set()
    for i, text in texts:
        gone = bytearray(len(text) + 1)
        for s in rows[i]["removed"]:
            gone[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert rows[i]["text"] == "".join(c for c, g in zip(text, gone) if not g)
        may = bytearray(len(text) + 1)
        found = {}
        for pattern in (r"[^\n]+", r"(?:[^\n]|\n(?![\x20\x09-\x0D]*(?:\n|$)))+"):
            for m in re.finditer(pattern, text):
                inside = [x for w in re.finditer(r"[^\x20\x09-\x0D]+", m[0]) for x in range(m.start() + w.start(), m.start() + w.end())]
                if inside:
                    found[(inside[0], inside[-1])] = tuple(plain_words(m[0])), inside
        for _, (unit, inside) in sorted(found.items()):
            if unit in seen:
                assert all(gone[x] for x in inside)  # repeated lines and paragraphs go in full
                for x in inside:
                    may[x] = 1
            seen.add(unit)
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        w = plain_words(text)
        for k in range(len(w) - 12):
            if windows[tuple(w[k : k + 13])] > 1:
                may[at[k][0] : at[k + 12][1]] = b"\1" * (at[k + 12][1] - at[k][0])
        # Nothing else goes than repeated units and words of 13-word windows that occur twice.
        assert all(may[x] for a, b in at for x in range(a, b) if gone[x])
        own = [tuple(w[k : k + 24]) for k in range(len(w) - 23)]
        for k, x in enumerate(own):  # of each passage of 24 words that an earlier document has at least 13 go
            if x in seen24:
                assert sum(gone[at[k + j][0]] for j in range(24)) >= 13
        seen24.update(own)
    assert source == "table" or rows[8]["text"].strip() == ""
    assert substring_dedup.dedup_units(empty_documents(spark)).count() == 0


def test_substring_dedup_edges(spark):
    docs = edge_documents(spark)
    rows = substring_dedup.dedup_units(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(t[0]) for t in TEXTS)
    assert len({r["text"] for r in rows if r["doc_id"] == 9}) == 1  # repeated rows are one document
    again = " ".join(f"w{k}" for k in range(30))
    (one,) = substring_dedup.dedup_units(spark.createDataFrame([(1, f"{again} x {again} y {again}\n" + "a " * 40)], "doc_id long, text string")).collect()
    assert one["text"].startswith(f"{again} x y") and "a a a" in one["text"]  # the first occurrence of a repeat in one text stays


def test_substring_dedup_finds_a_passage_inside_lines(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(80))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(40)) + " " + passage + " " + " ".join(word() for _ in range(40))) for i in range(6)], "doc_id long, text string")
    for r in substring_dedup.dedup_units(docs).collect():
        assert (r["n_removed"] == 0) == (r["doc_id"] == 0)
        assert r["doc_id"] == 0 or sum(s["end"] - s["start"] for s in r["removed"]) >= len(passage)  # to its ends


# ---- 4 URL filters ----


def test_url_filter_intervals_and_edges(spark):
    entries = spark.createDataFrame(
        [("x.org", "block", "2024-01-10"), ("x.org", "allow", "2024-02-01"), ("good.x.org", "allow", "2024-01-01"), ("y.org/bad", "block", "2024-01-01"), ("x.org", "block", "2024-02-01"), (None, "block", "2024-01-01"), ("z.org", None, "2024-01-01")],
        "pattern string, action string, day string",
    )
    captures = spark.createDataFrame(
        [(1, "http://a.x.org/p", "2024-01-09", 1), (2, "http://A.X.org:80/p", "2024-01-10", 1), (3, "https://good.x.org", "2024-01-20", 1), (4, "https://x.org", "2024-02-02", 1), (5, "http://y.org/bad/q?x#y", "2025-01-01", 1),
         (6, "http://y.org/good", "2024-03-01", 1), (7, None, "2024-03-01", 1), (8, "not a url", None, 1), (2, "http://A.X.org:80/p", "2024-01-10", 1), (None, "http://x.org", "2024-01-15", 1)],
        "page_id long, url string, fetch_day string, pattern long",
    )
    rows = url_filter.filter_urls(captures, entries).collect()
    got = sorted((r["page_id"] or 0, r["blocked"], r["pattern"]) for r in rows) if all(r["pattern"] is None or r["pattern"] for r in rows) else None
    assert [(p, b) for p, b, _ in sorted(got, key=lambda x: (x[0], x[1]))] == [(0, True), (1, False), (2, True), (2, True), (3, False), (4, False), (5, True), (6, False), (7, False), (8, False)]
    paths = spark.createDataFrame([("Y.org/Bad", "block", "2024-01-01"), ("z.org/a/b/", "block", "2024-01-01"), ("z.org/a/b/keep", "allow", "2024-01-01")], "pattern string, action string, day string")
    urls = ["http://y.org/Bad/x", "http://y.org/bad/x", "http://Z.org/a/b/c?q", "http://z.org/a/bc", "http://z.org/a/b/keep/it", "http://z.org/a/b"]
    found = url_filter.filter_urls(spark.createDataFrame([(i, u, "2024-05-05") for i, u in enumerate(urls)], "page_id long, url string, fetch_day string"), paths).orderBy("page_id").collect()
    assert [(r["pattern"], r["blocked"]) for r in found] == [("y.org/Bad", True), (None, False), ("z.org/a/b", True), (None, False), ("z.org/a/b/keep", False), ("z.org/a/b", True)]
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0
    assert url_filter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0


# ---- 5 mixing ----


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return t | capped
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("source", ["edge", "table"])
def test_mixing(spark, source):
    docs = edge_documents(spark) if source == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix_plan(docs, range_rows=7)
    rows = plan.collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    target, taken = brute_targets(dict(sizes)), Counter()
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["cut_words"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes) and len(rows) == docs.count()
    assert by_key(plan) == by_key(mixing.mix_plan(docs.repartition(3), range_rows=50))
    mixed = mixing.apply_mix(docs, plan)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(taken.values())


def test_mixing_of_null_ids_and_clashing_names(spark):
    rows = [(None, f"text {k % 40} of some words", "a", k, k) for k in range(400)] + [(k, "one two three", "b", k, k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id long, copies long")
    plan = mixing.mix_plan(docs, range_rows=16)
    assert plan.count() == len(rows) and plan.where("taken > 3 * size").count() == 0
    target = brute_targets({"a": 2000, "b": 150})
    taken = {r["source"]: r["s"] for r in plan.groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert mixing.apply_mix(docs, plan).columns == docs.columns


def test_mixing_empty(spark):
    docs = empty_documents(spark)
    plan = mixing.mix_plan(docs)
    assert plan.count() == 0 and mixing.apply_mix(docs, plan).count() == 0


# ---- 6 secret scans ----


def test_secret_scan_edges(spark):
    docs = edge_documents(spark)
    rows = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    assert len(rows) == len({t[0] for t in TEXTS})
    r, text = rows[7], dict((t[0], t[1]) for t in TEXTS)[7]
    a, h, k = text.index("token"), text.index("24be"), text.index("AKIA")
    expect = f"assign:{a}:{h + 40},hex:{h}:{h + 40},access:{k}:{k + 20}"
    assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (1, 1, 1, sha(expect), expect)
    assert rows[3]["spans"] == "" and rows[3]["base_sha256"] == sha("")
    clean = {r["doc_id"]: r for r in secret_scan.redact_documents(docs).collect()}
    assert clean[7]["text"] == "<SECRET>\" and <SECRET> here" and clean[7]["n_chars"] == len(clean[7]["text"])
    assert clean[3]["text"] is None and clean[1]["text"] == TEXTS[0][1]
    assert secret_scan.find_secrets(empty_documents(spark)).count() == 0


def test_base_spans_of_the_whole_table_against_plain_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kinds = (
        ("assign", re.compile("(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(kinds) for m in pattern.finditer(r["text"] or "") if ok(m))
        g = got[r["doc_id"]]
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        said = [f"{kinds[k][0]}:{a}:{e}" for a, k, e in spans]
        assert g["base_sha256"] == sha(",".join(said)) and set(said) <= set(g["spans"].split(",")) | {""}


def test_recall_and_precision_of_added_spans():
    """Credentials of known formats without their labels, in plain text, found by automata that learned from labelled ones."""
    rnd = random.Random(12)
    pick = lambda a, n: "".join(rnd.choice(a) for _ in range(n))
    makers = [lambda: pick("0123456789abcdef", 40), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40)]
    word = lambda: pick("etaoinshrdlucmfwypv", rnd.randrange(2, 14))
    plain = lambda: " ".join(word() for _ in range(40))
    learned = secret_scan.formats_of([("assign", makers[i % 3]()) for i in range(300)] + [("access", makers[1]()) for _ in range(200)] + [("hex", makers[0]()) for _ in range(200)], Counter(secret_scan.class_pairs([plain() for _ in range(500)])))
    hit, wrong, n = Counter(), 0, 100
    for i in range(3 * n):
        value = [makers[0]()[:28], "AKIA" + makers[1]()[4:15], makers[2]()][i % 3]
        text = f"{plain()} {value} {plain()}"
        found = [(a, e) for a, k, e in secret_scan.scan_text(text, learned)[1] if k.startswith("like_")]
        at = text.index(value)
        hit[i % 3] += any(a <= at + 2 and e >= at + len(value) - 2 for a, e in found)
        wrong += sum(not (a < at + len(value) and at < e) for a, e in found)
    assert min(hit[k] for k in range(3)) >= 0.9 * n and hit.total() / (hit.total() + wrong) >= 0.9


def test_secret_scan_failing_matches_and_rules():
    spans = lambda t: [(secret_scan.KINDS[k], t[s:e]) for s, k, e, _ in secret_scan.base_spans(t)[0]]
    assert spans("token=token:abcdefgh1") == []
    assert spans("PASSWORD: 'abcdefgh'") == [("assign", "PASSWORD: 'abcdefgh")]
    assert spans("api_key=\"abc\"") == [] and spans("Apikey\" : abcdefgh") == [("assign", "Apikey\" : abcdefgh")]
    assert spans("x" + "0" * 31) == [] and spans("z" + "0" * 33 + "g") == [("hex", "0" * 33)]
    assert spans("AKIAAKIA" + "B" * 8) == [("access", "AKIAAKIA" + "B" * 8)]


def test_automata_learn_formats(spark):
    rnd = random.Random(2)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    keys = lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    texts = [f"some plain words token={hexes(40)} and {keys()} then internationalizations-everywhere follow" for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    formats = secret_scan.learn_formats(docs)
    assert formats.kind(hexes(30)) and formats.kind("AKIA" + "Q7" * 5) is not None
    assert formats.kind("internationalizations-everywhere") is None and formats.kind("thththerandanotherword") is None
    text = f"a {hexes(28)} b"
    assert [k for _, k, _ in secret_scan.scan_text(text, formats)[1]] and not secret_scan.base_spans(text)[0]


# ---- 7 BPE ----


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary()), bpe.WordBpe.from_json(open(vocabulary(), encoding="utf-8").read())
    texts = [t[1] or "" for t in TEXTS] + ["ΣΑΣ İx Å Å x\x1cy \x85z\xa0w", "don't I'LL we've 'S 123 a1b2 !!?? <|endoftext|>x<|startoftext|> <|endoftext|", "\U0001f600\U0001f600 你好 가", "a" * 3000, "ab" * 900 + "'s"]
    for text in texts + texts[:3]:
        ids = library.encode(text, add_special_tokens=False).ids
        n, raw, decoded = own.encode(text)
        assert (n, np.frombuffer(raw, "<u4").tolist(), decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))


def test_bpe_cache_turns_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    own = bpe.WordBpe.from_json(open(vocabulary(), encoding="utf-8").read())
    text = "alpha beta gamma delta epsilon zeta eta theta alpha beta gamma"
    first = own.encode(text)
    assert first == own.encode(text) and len(own.young) <= 5


def test_bpe_merges_a_word_of_many_once(monkeypatch):
    own = bpe.WordBpe.from_json(open(vocabulary(), encoding="utf-8").read())
    merged = []
    monkeypatch.setattr(own, "merge", lambda ids: merged.append(1) or ids[:1])
    words = [f"{a}{b}{c}{d}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst" for c in "abcdefghijklmnopqrst" for d in "abcdefghijklmnopqrstuvwxyzäöüßéèêñç"]
    for _ in range(2):
        assert own.encode(" ".join(words))[0] == len(words)
    assert len(merged) == len(words) == 280_000


def test_bpe_edges(spark):
    docs = edge_documents(spark)
    rows = bpe.encode_documents(docs, vocabulary(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert {r["decoded_sha256"] for r in rows if r["doc_id"] in (3, 4, 5)} == {sha("")}
    back = bpe.decode_documents(bpe.encode_documents(docs, vocabulary(), ("ids", "decoded")).withColumnRenamed("decoded", "expect"), vocabulary())
    assert back.where("decoded <> expect").count() == 0
    assert bpe.encode_documents(empty_documents(spark), vocabulary()).count() == 0


# ---- 8 SimHash ----


def brute_simhash(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    comp = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    best = {}
    for i, c in enumerate(comp):
        if ids[i] is not None:
            best[c] = min(best.get(c, ids[i]), ids[i])
    return [best.get(c) for c in comp]


@pytest.mark.parametrize("radius", [2, 6])
def test_simhash_against_brute_force(spark, radius):
    docs = edge_documents(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = docs.collect()
    ids, prints = [r["doc_id"] for r in rows], [brute_simhash(r["text"]) for r in rows]
    expect = sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints, radius))), key=str)
    got = simhash.near_duplicates(docs, radius=radius).select("doc_id", "fingerprint", "component_id")
    assert by_key(got) == expect


@pytest.mark.parametrize("radius", [2, 4])
def test_simhash_shards_lose_no_pair(spark, monkeypatch, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    points = np.unique(np.concatenate([base, flip(base[:600]), flip(flip(base[200:700])), flip(flip(flip(base[:300])))]))
    monkeypatch.setattr(simhash, "SHARD", 200)
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    links = components.components(simhash.link_forest(fps, radius)).collect()
    root = {r["node"]: r["root"] for r in links}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    signed = points.view(np.int64)
    comp = signed.copy()
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(points))])
        if (new == comp).all():
            break
        comp = new
    assert all(root.get(int(s), int(s)) == c for s, c in zip(signed, comp.tolist()))


def test_simhash_cuts_shards_again_and_works_off_what_no_tree_cuts(spark, monkeypatch):
    """More shards than a sample has leaves, and a ball of fingerprints that lie within the radius of every cut."""
    rng = np.random.default_rng(8)
    spread = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    ball = np.uint64(12345) ^ np.array([(1 << a) ^ (1 << b) for a in range(40) for b in range(a)], np.uint64)
    near = spread[:300] ^ np.uint64(1 << 7)
    points = np.unique(np.concatenate([spread, ball, near]))
    for name, v in (("SHARD", 60), ("SAMPLE", 64), ("DEPTH", 2), ("ROUNDS", 3)):
        monkeypatch.setattr(simhash, name, v)
    fps = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long").repartition(3)
    root = {r["node"]: r["root"] for r in components.components(simhash.link_forest(fps, 2)).collect()}
    comp = list(range(len(points)))
    forest = simhash.Forest(len(points))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    forest.link(i, j)
    mine, theirs = {}, {}
    for k, p in enumerate(points.view(np.int64).tolist()):
        mine.setdefault(forest.find(comp[k]), set()).add(p)
        theirs.setdefault(root.get(p, p), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_simhash_shards_copy_few_and_join_nothing(spark, monkeypatch):
    """Of a pair across a cut one side is copied, and no table of sizes or trees is joined with the fingerprints."""
    monkeypatch.setattr(simhash, "SHARD", 250)
    points = np.unique(np.random.default_rng(5).integers(0, 2**63, 4000, dtype=np.uint64)).view(np.int64)
    laid = simhash.shards(spark.createDataFrame([(int(x),) for x in points], "fp long"))
    assert laid.count() < 3.5 * len(points)
    assert "Join" not in laid._jdf.queryExecution().optimizedPlan().toString()


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(links.limit(0)).count() == 0


def test_keep_one(spark):
    docs = edge_documents(spark)
    kept = simhash.keep_one(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(9) == 1 and ids.count(1) == 1 and 8 not in ids and 3 in ids and 4 not in ids
    assert simhash.keep_one(empty_documents(spark)).count() == 0


# ---- 9 language-model scoring ----


def held(i):
    return i is not None and crc(i, 10) == 0


def brute_model(lines, order):
    """Interpolated Witten-Bell probabilities of bytes, straight from counts of all n-grams."""
    n, of, kinds = Counter(), Counter(), Counter()
    for line in lines:
        x = b"\n" * (order - 1) + line + b"\n"
        n.update(x[i + 1 - k : i + 1] for i in range(order - 1, len(x)) for k in range(1, order + 1))
    for g, c in n.items():
        of[g[:-1]] += c
        kinds[g[:-1]] += 1

    @functools.cache
    def p(g):
        if len(g) == 1:
            return (n[g] + 0.5) / (of[b""] + 128)
        return (n[g] + kinds[g[:-1]] * p(g[1:])) / (of[g[:-1]] + kinds[g[:-1]]) if of[g[:-1]] else p(g[1:])

    def score(line):
        x = b"\n" * (order - 1) + line + b"\n"
        return sum(math.log10(p(x[i + 1 - order : i + 1])) for i in range(order - 1, len(x)))

    return n, p, score


def line_of(text):
    return b" ".join((text or "").encode().lower().split())


def test_lm_against_brute_force(spark):
    """Base score, counts and the automaton's score on the whole small table and the edge cases."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_documents(spark).select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = docs.collect()
    counts = Counter()
    for r in rows:
        if not held(r["doc_id"]):
            counts.update([*words(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    _, _, score = brute_model([line_of(r["text"]) for r in rows if not held(r["doc_id"])], lm_scoring.ORDER)
    got = lm_scoring.score_documents(docs).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    for r in rows:
        if r["doc_id"] is None:
            continue
        w = [*words(r["text"]), None]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        g = found[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held(r["doc_id"]), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(g["base_score"], base, rel_tol=1e-9) and math.isclose(g["score"], score(line_of(r["text"])), rel_tol=1e-9)
    assert lm_scoring.score_documents(empty_documents(spark)).count() == 0
    alone = lm_scoring.score_documents(spark.createDataFrame([(6, "ab")], "doc_id long, text string").where(held_out_id(6))).collect()
    assert all(math.isclose(r["score"], -3 * math.log10(256)) for r in alone)


def held_out_id(i):
    return F.lit(held(i))


def test_lm_blocks_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text").limit(80)
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs).collect()}
    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)
    small = lm_scoring.score_documents(docs, id_col="id").collect()  # string ids stay
    assert all(math.isclose(whole[int(r["doc_id"])], r["score"], rel_tol=1e-12) for r in small) and len(small) == len(whole)


def test_automaton_walks_pieces_and_is_a_distribution(monkeypatch):
    lines = [line_of(t[1]) for t in TEXTS if t[1] and len(t[1]) < 5000]
    n, p, score = brute_model(lines, lm_scoring.ORDER)
    contexts = {g[:-1] for g in n if len(g) > 1}
    of, kinds = Counter(), Counter()
    for g, c in n.items():
        of[g[:-1]] += c
        kinds[g[:-1]] += 1
    grams = sorted(set(n) | contexts)
    number = lambda g: int.from_bytes(g, "big")
    model = lm_scoring.Automaton(
        np.array([len(g) for g in grams]), np.array([number(g) for g in grams]),
        np.array([math.log10(p(g)) if g in n else np.nan for g in grams]),
        np.array([math.log10(kinds[g] / (of[g] + kinds[g])) if g in contexts else np.nan for g in grams]), math.log10(0.5 / (of[b""] + 128)),
    )
    texts = [*lines, b"something else entirely 999", b"", lines[0] * 3]
    expect = [score(x) for x in texts]
    assert np.allclose(model.scores(texts), expect, rtol=1e-12)
    monkeypatch.setattr(lm_scoring, "PIECE", 11)
    assert np.allclose(model.scores(texts), expect, rtol=1e-12)
    for s in range(0, len(model.fail), 7):
        _, weight = model.step(np.full(256, s), np.arange(256))
        assert math.isclose((10**weight).sum(), 1, rel_tol=1e-9)


# ---- 10 quality rules ----


def test_quality_edges(spark):
    docs = edge_documents(spark)
    rows = quality.quality_rules(docs, min_docs=1).collect()
    assert len(rows) == len(TEXTS)
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["n_words"] == 0 and got[3]["base_failed"] and not got[3]["kept"]
    assert got[11]["n_words"] == 24 and got[11]["n_repeat_words"] == 24 and not got[11]["kept"]
    assert got[1]["removed_words"] == 28 and not got[1]["kept"]  # line 1 is document 8's, line 2 is document 2's too
    assert got[2]["removed_words"] == 6 and got[2]["kept"]
    assert [r["n_words"] for r in rows if r["doc_id"] == 9] == [4, 4]
    assert quality.quality_rules(empty_documents(spark)).count() == 0


def test_quality_counts_repeated_rows_once_and_removes_lines(spark):
    rows = [(1, "one same line\nown words here", "a")] * 30 + [(k, f"text {k}\nfooter of all", "a") for k in range(2, 30)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["removed_words"]) for r in quality.quality_rules(docs, min_docs=5).collect()}
    assert got == {(1, 0), (None, 0)} | {(k, 3) for k in range(2, 30)}
    cleaned = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in quality.remove_frequent_lines(docs, min_docs=5).collect()}
    assert cleaned == {1: (rows[0][1], []), None: (None, [])} | {k: (f"text {k}", [1]) for k in range(2, 30)}


def test_quality_repeat_windows_against_brute_force(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.base_rules(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        w = text.split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert got[i] == len(covered)
