"""The documents from raw to packed: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.core.staging import stage
from plangauge.llm import exact_dedup, langid, minhash, packing, pii
from plangauge.llm.queries import PII_KEY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those with a null or empty text or without a letter go.

    Rows with null or repeated ids and repeated rows are judged each by their text; other columns stay. Where nothing was learnt no
    document has a language, and all go; an empty table gives an empty one.
    """
    samples = langid.fit(docs.where(langid.may_learn(F.col("doc_id"))))
    return langid.identify(docs, samples).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id, then the first row of the table; null counts as empty. Nothing else is dropped."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: 5-word shingles, similarity 0.8 or more; the smallest id, then the first row.

    Null and empty texts all stay. Long texts are compared whole. An empty table gives an empty one.
    """
    return minhash.near_dedup(docs, minhash.Near(width=5, percent=80))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with pseudonyms for personal data; no row is dropped, null texts stay null, other columns stay as they are."""
    return pii.pseudonymise(docs, PII_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens; a null text is its end token alone, rows with equal ids are packed each, an empty table gives no piece."""
    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("private_data", private_data), ("packed", packed)]

#: The first, third and last stage are beyond SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
