"""The pipeline's near-dedup stage against brute-force Jaccard similarity of 5-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from stimulake.llm import near_copies, simhash

from .helpers import words

SF = "/root/testdata/sf0.001"


def brute_kept(rows):
    """Smallest id of each group that exact similarities of 0.8 or more connect."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if comp[i] != comp[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    best = {}
    for (i, _), c in zip(rows, comp):
        best[c] = min(best.get(c, i), i)
    return sorted(best.values())


def edited(rnd, text, n):
    w = text.split()
    for at in rnd.sample(range(10, len(w) - 10), n):
        w[at] = f"x{rnd.random()}"
    return " ".join(w)


def planted():
    """Copies of random texts with 1 to 8 of 300 words replaced: similarities from about 0.77 to 0.97."""
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        base = " ".join(f"w{rnd.randrange(3000)}" for _ in range(300))
        rows += [base] + [edited(rnd, base, n) for n in range(1, 9)]
    rows += [f"short text {k % 7}" for k in range(20)] + [rows[0].upper(), rows[0]]
    return list(enumerate(rows))


@pytest.mark.parametrize("source", ["planted", "table"])
def test_stage_drops_what_jaccard_says(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "table" else spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in planted()], "doc_id long, text string, lang string, source string, n_chars long")
    expect = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == expect


def test_candidates_reach_similarity_threshold():
    rnd, hit, n = random.Random(3), 0, 0
    for _ in range(60):
        base = " ".join(f"w{rnd.random()}" for _ in range(300))
        other = edited(rnd, base, 6)
        a, b = (near_copies.band_keys(t.encode()) for t in (base, other))
        if near_copies.alike(near_copies.shingles(base.encode()), near_copies.shingles(other.encode())):
            n, hit = n + 1, hit + bool(np.equal(a, b).any())
    assert n > 20 and hit == n


def test_keys_of_many_blocks(spark, monkeypatch):
    """Keys dealt into blocks of three texts connect what keys of one block do."""
    monkeypatch.setattr(near_copies, "GROUP", 3)
    rows = planted()[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)


def test_stage_goes_through_operator_8(spark, monkeypatch):
    """All fingerprints meet in operator 8's shards, and the copies that it links are kept from the other search."""
    seen, asked = [], []
    forest, verified = simhash.link_forest, near_copies._verified
    monkeypatch.setattr(simhash, "link_forest", lambda fps, *a: seen.append(fps) or forest(fps, *a))
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(1, text), (2, text.upper()), (3, text + " "), (4, "another text of few words"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == [1, 4, 5]
    assert sorted(r["fp"] for r in seen[0].collect()) == sorted({int(np.uint64(simhash.simhash((t or "").encode())).view(np.int64)) for _, t in rows})
    assert asked == [2, 0]
