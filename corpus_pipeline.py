"""A corpus pipeline: language ID, exact dedup, near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. A null or empty text is not identified and goes in
the first stage; very long texts pass whole; of repeated rows and ties one row stays, by the operators' rules; empty tables
give empty results; extra columns stay as they are up to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isomere.llm import byte_bpe, common, exact_dedup, language_id, minhash, mixing


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that no language fits; one without a language in its column gets the one found."""
    common.small_batches(spark)
    learnt = docs.filter(~language_id.held_out(F.col("doc_id"))).select("lang", "text")
    return language_id.keep_identified(docs, language_id.train(learnt))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    common.small_batches(spark)
    return exact_dedup.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    common.small_batches(spark)
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    common.small_batches(spark)
    return mixing.sample(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    common.small_batches(spark)
    return byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identified),
    ("exact dedup", distinct),
    ("near-dedup", dissimilar),
    ("mixing", mixed),
    ("BPE", encoded),
]

#: Signatures, raking and tokens have no form in SQL; a brute-force version in tests/llm checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is kept in the shared checkpoint folder."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, f"pipeline-{uuid.uuid4().hex}-{k}")
    return docs
