"""The stages of the corpus pipeline: each works on all documents that the one before has kept, and all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.llm import byte_bpe, decontamination, language_id, sanitisation, simhash
from assayframe.llm.queries import RANKS, table

#: What a task of the last stage may hold: less than alone, since executors have grown by the stages before.
CODER_CACHE, CODER_QUERY = 16_000_000, 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; the labels themselves stay as they are."""
    model = language_id.learn(docs.where(language_id.is_training(F.col("doc_id"))))
    return language_id.identify(docs, model).where("not rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and the terms that give it away generalised or removed."""
    return sanitisation.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, their digest, and that of what they decode to."""
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, cache_bytes=CODER_CACHE, query_chars=CODER_QUERY, ids=True)
    return coded.drop("text")
