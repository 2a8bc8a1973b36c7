"""A corpus pipeline of five stages, each calling one training-data operator on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import bpe, langid, minhash, mixing, pii
from tapeline.llm.common import small_reads, written


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; rejected documents go."""
    small_reads(spark)
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five words and a similarity of 0.8; one document of each group stays."""
    small_reads(spark)
    return minhash.keep_one_each(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are replaced in the text."""
    small_reads(spark)
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated or left out as the mix takes them."""
    small_reads(spark)
    return mixing.mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    import public_tokenizers

    small_reads(spark)
    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens", "ids_sha256", (F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")), 256)).alias("round_trip"))


STAGES = [
    ("language_id", identify_languages),
    ("minhash_dedup", drop_near_duplicates),
    ("pii", remove_personal_data),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: Merges of a tokenizer and components of verified links have no SQL form here; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
