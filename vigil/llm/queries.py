"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import (bpe, byte_bpe, chat, decontaminate, hamming_search, html_extract, oracle, oracle_codes, pii, quality, sharding, simhash,
                       spelling, substring_dedup, vector_codes)
from vigil.llm.common import table


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op5(table(spark, sf_dir, "documents"))


def op6_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op6(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The byte-level vocabulary file; it stays outside the repository."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op1(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.op2(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.op7(table(spark, sf_dir, "embeddings"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8(table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.op11(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.op13(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_html_extraction, op3_decontamination, op4_bpe_codec, op5_simhash_near_dedup, op6_histogram_sharding,
    op7_hamming_top_k, op8_chat_formatting, op9_quality, op10_pii, op11_vector_codes, op12_spelling_variants, op13_byte_bpe)}
SQL: dict[str, str] = {"op1_substring_dedup": oracle.OP1, "op3_decontamination": oracle.OP3, "op7_hamming_top_k": oracle.OP7,
                       "op8_chat_formatting": oracle.OP8, "op11_vector_codes": oracle_codes.OP11, "op12_spelling_variants": oracle_codes.OP12}
