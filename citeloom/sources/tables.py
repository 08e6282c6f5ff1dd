"""Tables as the operators want them, from Parquet with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("pmid", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("abstract", T.StringType(), False),
        T.StructField("year", T.IntegerType()),
        T.StructField("journal", T.StringType()),
        T.StructField("mesh_terms", T.ArrayType(T.StringType()), False),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """(pmid, title, abstract, lang, journal, seq): the first line is the title, the rest, or the whole of a single line, the abstract."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents")
    return (rows if only is None else rows.filter(only)).select(
        F.col("doc_id").cast("string").alias("pmid"),
        F.substring_index(text, "\n", 1).alias("title"),
        F.when(F.instr(text, "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(text).alias("abstract"),
        "lang",
        F.col("source").alias("journal"),
        F.col("doc_id").alias("seq"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, vec_id, vector, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("pmid"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the turn of the assistant right after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"])
