"""From raw documents to packed training sequences: each stage works on what the one before kept.

All stages but the last return all columns of their input, whatever their names (text and n_chars as redacted). Null texts count as
empty, stay null, and are exact copies of empty ones, of which one row stays; texts without words have no near duplicates; in the end an
empty text is packed as its one end token. Rows without id are kept as others are, but one with an id is preferred among copies. Rows that
repeat an id and text are copies. Empty documents give an empty result; without labels no document is toxic.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import stash
from citeloom.llm.exact_dedup import drop_exact_duplicates
from citeloom.llm.near_dedup import drop_near_duplicates
from citeloom.llm.packing import pack_documents
from citeloom.llm.secrets import redact_secrets
from citeloom.llm.toxicity import drop_toxic


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one of the largest id."""
    return drop_exact_duplicates(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, by five-word shingles at 0.8, the document of the smallest id."""
    return drop_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts redacted and n_chars as it then is."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", keep_one_copy),
    ("near_dedup", keep_one_of_similar),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The learned model, similarities and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between two of them the rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
