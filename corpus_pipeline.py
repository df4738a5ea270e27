"""A corpus pipeline of four stages, each over all that the one before it kept.

Each stage sets the session's limit of bytes in an Arrow batch (``small_batches``), and leaves it set, since the last result is computed after it returns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm.langid import identified
from llm.minhash import dedup
from llm.packing import pack
from llm.quality import accepted, trusted_ids
from llm.store import small_batches, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter go."""
    small_batches(spark)
    return identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    small_batches(spark)
    return accepted(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8)."""
    small_batches(spark)
    return dedup(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: SQL can express neither the language profiles nor the perplexities. A test holds the rows of all stages against plain versions but for the
#: verdicts of ``quality``, whose perplexities other tests hold against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
