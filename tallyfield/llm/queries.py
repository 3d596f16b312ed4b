"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.bpe import encoding_digests
from tallyfield.llm.chat import conversation_digests
from tallyfield.llm.common import read_table
from tallyfield.llm.language import predict_language, train_language_model
from tallyfield.llm.licenses import scan_licenses
from tallyfield.llm.matching import deduplicate_words
from tallyfield.llm.mixing import with_schedule
from tallyfield.llm.near import near_duplicates
from tallyfield.llm.oracle import oracle_sql  # noqa: F401  (part of this module's contract)
from tallyfield.llm.quality import repetition_quality
from tallyfield.llm.substrings import deduplicated_digests
from tallyfield.llm.topk import top_k_search


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict_language(docs, train_language_model(docs))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    own = "</s>[INST] ok [/INST]"
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    return conversation_digests(rows.unionByName(extra), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("n_tokens")


def op3_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_words(read_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return with_schedule(docs)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_digests(read_table(spark, sf_dir, "documents"))


def op10_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(read_table(spark, sf_dir, "documents")).drop("longest_repeat")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_chat_format, op3_fm_substring_dedup, op4_bpe_encode, op5_minhash_near_dedup, op6_source_mix, op7_topk_search, op8_license_scan, op9_suffix_dedup, op10_repetition_quality)}
