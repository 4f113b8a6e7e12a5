"""The corpus pipeline: language identification, near-dedup, secret redaction, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as Parquet and read again as the next
one's documents. All but the last return the columns of the documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stimulake.llm import bpe, language_id, mixing, near_copies, secret_scan
from stimulake.llm._common import read, shared_dir
from stimulake.llm.queries import vocabulary

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word Jaccard 0.8 or more) stays: that of the smallest id.

    Operator 8 (fingerprints, vantage-point shards) links first, each link checked exactly; what it leaves apart is searched by min-hashes.
    """
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, their secrets replaced."""
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, the one at a source's cut shortened to its budget."""
    return mixing.apply_mix(docs, mixing.mix_plan(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, vocabulary(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"), keep=("source",))


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: Machines, trees, automata and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what lies between two stages is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stimulake-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
