"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm.bpe_count import token_counts
from cohortloom.llm.decontaminate import contaminated
from cohortloom.llm.embedding_dedup import near_vectors
from cohortloom.llm.html_extract import main_text
from cohortloom.llm.langid import languages
from cohortloom.llm.merkle import manifest
from cohortloom.llm.near_dedup import near_duplicates
from cohortloom.llm.oracles import DECONTAMINATION, MANIFEST, NEAR_DUPLICATES, NEAR_VECTORS, VECTOR_CODES
from cohortloom.llm.order_minhash import edited_fingerprints
from cohortloom.llm.packing import pack_documents
from cohortloom.llm.pii import personal_data
from cohortloom.llm.piece_bpe import encoding_digests
from cohortloom.llm.secrets import secret_spans
from cohortloom.llm.vector_codes import vector_codes

WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))


def op8_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_packing": op1_packing, "op2_main_text": op2_main_text, "op3_personal_data": op3_personal_data,
    "op4_near_duplicates": op4_near_duplicates, "op5_languages": op5_languages, "op6_order_minhash": op6_order_minhash,
    "op7_token_counts": op7_token_counts, "op8_piece_encoding": op8_piece_encoding, "op9_secrets": op9_secrets,
    "op10_near_vectors": op10_near_vectors, "op11_decontamination": op11_decontamination, "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op4_near_duplicates": NEAR_DUPLICATES, "op10_near_vectors": NEAR_VECTORS, "op11_decontamination": DECONTAMINATION,
    "op12_merkle_manifest": MANIFEST, "op13_vector_codes": VECTOR_CODES,
}
