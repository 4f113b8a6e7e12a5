"""Phrases against brute force: whole tables, tiny tiles and chunks, large counts, edges."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stimulake.llm import collocations as C

from .helpers import TEXTS, edge_documents, empty_documents

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, share=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in found.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * found[q]}
        best = []
        for p in found.keys() - gone:
            a = c[p]
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expect = brute([tuple(r) for r in docs.select("lang", "text").collect()])
    assert len(expect) > 1000 and rows_of(C.collocations(docs)) == expect


def test_tiny_tiles_and_chunks_give_the_same(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["The", "of", "and", "É", "é", "x|y", "a\x0bb", "long\x85word", "ß", "　"] + [f"w{i}" for i in range(30)]
    text = lambda: "".join(words[min(rnd.randrange(40), rnd.randrange(40))] + rnd.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rnd.randrange(400)))
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice([text(), text(), None, "", " \t"])) for _ in range(300)] + [("en", "the same words again here " * 500)] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for settings in ({"bits": 2, "chunk_words": 70, "split": 50}, {"least": 3, "top": 7}):
        got = rows_of(C.collocations(docs, **settings))
        assert got == brute(rows, settings.get("least", 10), 50, settings.get("top", 2000))


def test_text_is_split_alike_in_any_pieces(monkeypatch):
    text = "Ab cd, ef\tgh. " * 50 + "one-very-long-word" * 20
    whole = [w for _, words in C.splits(text.encode()) for w in words if w]
    monkeypatch.setattr(C, "PIECE", 7)
    parts = list(C.splits(text.encode()))
    assert len(parts) > 10 and [w for _, words in parts for w in words if w] == whole
    assert sum(n for n, _ in parts) == len(text) + 1


def test_tiles_with_and_without_bincount():
    rng = np.random.default_rng(4)
    hi, lo = rng.geometric(0.05, 5000), rng.geometric(0.02, 5000)
    for bits in (1, 3, 5, 28):
        found = Counter()
        for ti, tj, cell, count in C.counted(hi, lo, bits):
            side = 1 << bits
            found.update(dict(zip(zip((ti * side + cell // side).tolist(), (tj * side + cell % side).tolist()), count.tolist())))
        assert found == Counter(zip(hi.tolist(), lo.tolist()))


def test_scores_of_large_counts_are_exact(spark):
    rows = [(999_999_999_989, 999_999_999_999, 999_999_999_990), (10, 10, 10), (123_456_789_012, 323_456_789_013, 923_456_789_012)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", C._score("a", "l", "r").alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_edges_and_empty(spark):
    docs = edge_documents(spark)
    assert rows_of(C.collocations(docs)) == brute([(lang, t) for _, t, lang, _ in TEXTS])
    assert C.collocations(empty_documents(spark)).collect() == []
    assert C.collocations(docs.where("doc_id < 3")).collect() == []
    alone = docs.where("doc_id = 6").withColumns({"lang": F.lit(None).cast("string"), "text": F.lit("so it goes " * 20)})
    assert {r["lang"] for r in C.collocations(alone).collect()} == {"und"}


def test_counting_holds_few_copies_and_makes_short_rows():
    rng = np.random.default_rng(5)
    n = 1 << 22
    held = [(rng.integers(0, 4096, n // 8), rng.integers(0, 1 << 15, n // 8).astype(np.int32)) for _ in range(8)]
    g = C.Gathered.__new__(C.Gathered)
    g.bits, g.part, g.lang, g.held, g.size = 11, 0, "en", held, n
    del held
    tracemalloc.start()
    try:
        longest = cells = pairs = 0
        for batch in g.out():
            longest = max(longest, *batch.column("cells").value_lengths().to_pylist(), batch.num_rows)
            cells += len(batch.column("cells").flatten())
            pairs += sum(batch.column("n").to_pylist())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert pairs == n and cells > 3 * C.ROW_CELLS and longest <= C.ROW_CELLS
    assert peak < 40 * n  # bytes: a pair comes as 12 and becomes a key of 8


def test_tiles_in_pieces_add_up_alike(spark, monkeypatch):
    rng = np.random.default_rng(6)
    batch = lambda hi, lo: [C.tile_rows("en", i % 3, *found) for i, found in enumerate(C.counted(hi, lo, 3))]
    hi, lo = rng.geometric(0.05, 20000), rng.geometric(0.05, 20000)
    monkeypatch.setattr(C, "ROW_CELLS", 5)
    made = [b for k in range(0, 20000, 5000) for b in batch(hi[k : k + 5000], lo[k : k + 5000])]
    assert max(max(b.column("cells").value_lengths().to_pylist()) for b in made) <= 5
    tiles = spark.createDataFrame([tuple(r.values()) for b in made for r in b.to_pylist()], C.TILES)
    expect = Counter(zip(hi.tolist(), lo.tolist()))
    got = {(r["hi"], r["lo"]): r["f"] for r in C.cells_of(C.in_two_levels(tiles, 4, 3, 1), 3).collect()}
    assert got == {k: n for k, n in expect.items() if n >= 4}
    sizes = Counter()
    for (a, b), n in expect.items():
        sizes[a >> 3, b >> 3] += n
    found = C.in_two_levels(tiles, 4, 3, 1).where("n > 0").collect()
    assert Counter({(r["ti"], r["tj"]): r["n"] for r in found}) == sizes and len(found) == len(sizes)


def test_batches_to_python_are_short(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches)
    wide = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("x"))
    before = spark.conf.get(key, None)
    with C.short_batches(spark):
        assert max(r["n"] for r in wide.mapInArrow(sizes, "n long").collect()) < C.BATCH_BYTES + 50_000
    assert spark.conf.get(key, None) == before
