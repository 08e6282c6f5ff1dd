"""Checks of cited answers, sentence by sentence, and the ladder that falls back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

ENTAILMENT, NEUTRAL, CONTRADICTION = 0, 1, 2


def rule_label(premise: Column, hypothesis: Column, share: float = 0.8) -> Column:
    """A scorer without a model: entailment where the premise has at least ``share`` of the hypothesis' content terms, else neutral."""
    said = X.content_terms(hypothesis)
    return F.when(F.size(F.array_intersect(said, X.content_terms(premise))) >= share * F.size(said), ENTAILMENT).otherwise(NEUTRAL)


def verdicts(answers: DataFrame, docs: DataFrame, scorer: Callable[[Column, Column], Column] = rule_label) -> DataFrame:
    """(query_id, at, sentence, cited, label) of answers (query_id, text, passages): label null without a citation that resolves.

    A sentence is checked against the document of its first marker.
    """
    each = answers.select("query_id", "passages", F.posexplode(X.sentences(F.col("text"))).alias("at", "sentence"))
    cited = each.withColumn("cited", X.first_citation(F.col("sentence"), F.col("passages")))
    found = cited.join(docs.select(F.col("pmid").alias("cited"), X.chunk(F.col("title"), F.col("abstract")).alias("premise")), "cited", "left")
    hypothesis = F.regexp_replace("sentence", r"\s*\[\d+\]", "")
    return found.select("query_id", "at", "sentence", "cited", F.when(F.col("premise").isNotNull(), scorer(F.col("premise"), hypothesis)).alias("label"))


def report(answers: DataFrame, checked: DataFrame) -> DataFrame:
    """(query_id, n, precision, recall, hallucination, grounded): zeros and not grounded where an answer has no sentence."""
    entailed = F.sum(F.when(F.col("label") == ENTAILMENT, 1).otherwise(0))
    labelled = F.count("label")
    sums = checked.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.coalesce(entailed / F.nullif(labelled, F.lit(0)), F.lit(0.0)).alias("precision"),
        (F.count("cited") / F.count("*")).alias("recall"),
        ((F.count("*") - entailed) / F.count("*")).alias("hallucination"),
        (entailed == F.count("*")).alias("grounded"),
    )
    zero = {"n": F.lit(0).cast("long"), "precision": F.lit(0.0), "recall": F.lit(0.0), "hallucination": F.lit(0.0), "grounded": F.lit(False)}
    return answers.select("query_id").join(sums, "query_id", "left").select("query_id", *[F.coalesce(c, z).alias(c) for c, z in zero.items()])


def faithfulness(queries: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: means over the answered questions, and the share that has an answer."""
    rows = queries.select("query_id").join(reports, "query_id", "left")
    return rows.agg(F.count("*").alias("n_queries"), (F.count("n") / F.count("*")).alias("coverage"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("hallucination").alias("hallucination"), F.avg(F.col("grounded").cast("int")).alias("grounded"))


def ladder(queries: DataFrame, generated: DataFrame, reports: DataFrame, extracted: DataFrame) -> DataFrame:
    """(query_id, confidence, text): a grounded generated answer, else an extracted one, else abstention."""
    rows = queries.select("query_id").join(generated.select("query_id", F.col("text").alias("generated")), "query_id", "left").join(reports.select("query_id", "grounded"), "query_id", "left").join(extracted.select("query_id", F.col("text").alias("extracted")), "query_id", "left")
    ok = F.coalesce("grounded", F.lit(False)) & F.col("generated").isNotNull()
    return rows.select("query_id", F.when(ok, "grounded").when(F.col("extracted").isNotNull(), "extractive").otherwise("abstain").alias("confidence"), F.when(ok, F.col("generated")).otherwise(F.col("extracted")).alias("text"))


def covered(context: Column, question: Column) -> Column:
    """Share of the question's content terms that the context has, as a gate without a model."""
    asked = X.content_terms(question)
    return F.coalesce(F.size(F.array_intersect(asked, X.content_terms(context))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def answerability(queries: DataFrame, hits: DataFrame, docs: DataFrame, *, passages: int = 5, scorer: Callable[[Column, Column], Column] = covered) -> DataFrame:
    """(query_id, probability) that the joined passages answer the question, by ``scorer`` of context and question; a question without passages has an empty context."""
    joined = hits.filter(F.col("rank") <= passages).join(docs.select("pmid", X.chunk(F.col("title"), F.col("abstract")).alias("chunk")), "pmid").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk"))), lambda s: s["chunk"]), " ").alias("context"))
    rows = queries.join(joined, "query_id", "left")
    return rows.select("query_id", scorer(F.coalesce("context", F.lit("")), F.col("question")).alias("probability"))
