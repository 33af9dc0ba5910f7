"""The corpus pipeline: documents in, the encoded mixture out. Each stage is one operator of tidemark.llm.

Every stage takes what its predecessor kept (reread from Parquet) and returns the columns of ``documents``, the last one
the ids. Nulls, empty and very long texts, repeated rows and empty tables have the results their operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, crf, mix, simhash, suffix
from tidemark.llm.store import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good enough; the others go."""
    return crf.good_documents(docs, crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near copies."""
    return simhash.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has already; n_chars follows."""
    return suffix.cut(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document of the mixture, and hashes of the ids and of what they decode to."""
    return bpe.encode(docs, columns=("ids", "n_tokens", "ids_sha256", "decoded_sha256"), memo=50_000, slice_bytes=512 << 10, reuse=False)


STAGES = [("quality", quality), ("simhash", near_copies), ("suffix", repeats), ("mix", mixture), ("bpe", encoded)]
#: SQL can express neither the random field nor the hashes that the other stages decide by.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row of the mixture, from the documents in sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs)
            scratch.drop(before)
    return docs
