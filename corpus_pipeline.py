"""From documents to packed training sequences: language ID, near duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.langid import UNKNOWN, fit_profiles, predict_languages
from cohortloom.llm.near_dedup import near_duplicates
from cohortloom.llm.packing import pack_documents
from cohortloom.llm.secrets import mask
from cohortloom.staging import broadcast_if_small, stage

#: The stages depend on fitted models, random planes and a library's ids, which SQL cannot express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null texts and texts without a letter.

    There is no floor for the score: in a small corpus clean documents share no n-gram with its few profiles.
    """
    profiles = fit_profiles(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("t"))
    return predict_languages(rows, profiles, "t", ("doc",)).where(F.col("lang_pred") != UNKNOWN).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and one row of rows that repeat an id and a text."""
    found = near_duplicates(docs).where("not kept and doc_id is not null")
    surplus = stage(found.select("doc_id").distinct(), "surplus")
    kept = docs.join(broadcast_if_small(surplus), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    some = broadcast_if_small(repeated)
    once = kept.join(some, "doc_id", "left_semi").select(kept.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(some, "doc_id", "left_anti").select(kept.columns).unionByName(once)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; ``n_chars`` follows. No document is dropped."""
    masked = mask(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again for the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
