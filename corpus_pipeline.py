"""The corpus pipeline: language ID, near-duplicates, repeated strings, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next one's docs.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.bpe import encode_documents
from tallyfield.llm.common import named, shared_folder
from tallyfield.llm.language import keep_determined, train_language_model
from tallyfield.llm.mixing import mixed_order, with_schedule
from tallyfield.llm.near import NearSettings, near_duplicates
from tallyfield.llm.substrings import deduplicate


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter, or no language with a fair share."""
    return keep_determined(docs, train_language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id: shingles of five words, 0.8.

    Rows that repeat both id and text are one document; rows without an id stay.
    """
    kept = near_duplicates(docs, NearSettings(words=5)).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.select(*named(docs.columns)).unionByName(docs.where("doc_id is null"))


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand elsewhere too are taken out of the texts; n_chars follows."""
    out = deduplicate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that reading them in order gives every source its weight."""
    return mixed_order(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its place in the mix.

    Files are read again in an order of Spark's choice, so the place is found again: it is a function of
    the rows alone. Results ordered by mix_position hold every source's weight.
    """
    placed = with_schedule(docs.select("doc_id", "text", "source")).select("doc_id", "text", "mix_position")
    return encode_documents(placed, public_tokenizers.path("word_bpe_49k.json"), ("mix_position",))


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("suffix_dedup", string_dedup), ("mixing", mix), ("bpe", tokens)]
#: A trained network's and a tokenizer's results can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage leaves is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
