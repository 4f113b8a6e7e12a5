"""The pipeline's stages on the small table, each held against its own input; and the registered queries against DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stimulake.llm import bpe, mixing, queries, secret_scan

from .helpers import edge_documents, sha, words
from .test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, found[-1], SF).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def test_stages_keep_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "secret_scan", "source_mix", "bpe"]


def test_stage_results(stages):
    docs, identified, deduped, redacted, mixed, encoded = stages
    assert all(x.columns == docs.columns for x in stages[:-1])
    assert identified.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert brute_kept([(r["doc_id"], r["text"]) for r in identified.collect()]) == sorted(r["doc_id"] for r in deduped.collect())
    clean, before = {r["doc_id"]: r for r in redacted.collect()}, {r["doc_id"]: r for r in deduped.collect()}
    assert clean.keys() == before.keys()
    for i, r in before.items():
        spans = secret_scan.base_spans(r["text"])[0]
        assert (clean[i]["text"] == r["text"]) == (not spans) and clean[i]["n_chars"] == len(clean[i]["text"])
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(redacted).collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
    assert taken == {k: v for k, v in plan.items() if v}
    own = bpe.WordBpe.from_json(open(queries.vocabulary(), encoding="utf-8").read())
    expect = sorted((r["doc_id"], *(lambda n, raw, text: (n, sha(raw), sha(text)))(*own.encode(r["text"]))) for r in mixed.collect())
    assert expect == sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded.collect())
    assert all(np.array(r["ids"]).size == r["n_tokens"] for r in encoded.collect())


def test_run_on_edge_cases(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    edge_documents(spark).select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    edge_documents(spark).select(*columns).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    expect = db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expect.columns)
    at = [expect.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in expect.fetchall())
