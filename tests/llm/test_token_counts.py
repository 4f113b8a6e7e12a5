"""Token counts against the library: whole table, hand-made and random texts, long pre-tokens, edges."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stimulake.llm import token_counts
from stimulake.llm.queries import op12_token_counts
from stimulake.llm.token_counts import MergeTable, alternate

from .helpers import TEXTS, edge_documents, empty_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def table():
    with open(PATH, encoding="utf-8") as f:
        return MergeTable.from_json(f.read())


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_table_against_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs}
    expect = dict(zip(texts, lengths(library, list(texts.values()))))
    rows = op12_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), expect[r["doc_id"]])
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_random_texts_against_library(library, table):
    rnd = random.Random(5)
    letters = "abcdeEÉéß你好 \t\n\r\x0b\x1c\x1d\x85\xa0 　'’.,!?0123٣½🙂‍́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(5000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "'s'S'll 'd", "  x   ", "\n\n x"]
    assert list(table.count(texts)) == lengths(library, texts)


def test_long_pre_tokens_and_pieces(library, table, monkeypatch):
    rnd = random.Random(6)
    texts = ["a" * 5001, "ab" * 3000 + "aaa", "".join(rnd.choice("abcdefgh") for _ in range(20_000)), " " * 3001, "你好" * 2000, "wort und " * 9000]
    expect = lengths(library, texts)
    assert list(table.count(texts)) == expect
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    monkeypatch.setattr(token_counts, "TOGETHER", 50)
    monkeypatch.setattr(token_counts, "CACHE", 20)
    assert list(table.count(texts)) == expect
    monkeypatch.setattr(token_counts, "LONG_WORD", 1)
    assert list(table.count(texts[3:])) == expect[3:]


def test_alternate():
    assert alternate(np.array([1, 2, 3, 7, 8, 20]), 1).tolist() == [1, 3, 7, 20]
    assert alternate(np.array([1, 4, 9]), np.array([4, 9, 12])).tolist() == [1, 9]


def test_merges_out_of_order_are_refused():
    vocab = {s: i for i, s in enumerate(token_counts.byte_symbols())} | {"ab": 256, "abc": 257}
    assert MergeTable(vocab, ["a b", "ab c"], []).merge_all([b"abcab", b""]).tolist() == [2, 0]
    with pytest.raises(ValueError):
        MergeTable(vocab, ["ab c", "a b"], [])


def test_edges_and_empty(spark, library):
    rows = token_counts.count_tokens(edge_documents(spark), PATH, limit=30).collect()
    texts = [t or "" for _, t, *_ in TEXTS]
    expect = sorted((str(i), len(t.encode()), n, n > 30) for (i, *_), t, n in zip(TEXTS, texts, lengths(library, texts)))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == expect
    assert token_counts.count_tokens(empty_documents(spark), PATH).collect() == []
