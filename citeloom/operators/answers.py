"""Cited answers out of retrieved documents, and when to abstain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

from .ranking import running


def extract(queries: DataFrame, hits: DataFrame, docs: DataFrame, *, passages: int = 5, sentences: int = 3) -> DataFrame:
    """(query_id, n, pmid, source, sentence, overlap): the sentences that answer each question, best first.

    Sentences come from the abstracts of the first ``passages`` documents and need a content term of the question; more
    distinct ones win, then the better passage, then the earlier sentence. ``source`` numbers the documents by their first
    sentence. A question without any such sentence has no row.
    """
    top = hits.filter(F.col("rank") <= passages).join(docs.select("pmid", "abstract"), "pmid").join(queries.select("query_id", X.content_terms(F.col("question")).alias("asked")), "query_id")
    each = top.select("query_id", "pmid", "rank", "asked", F.posexplode(X.sentences(F.col("abstract"))).alias("at", "sentence"))
    scored = each.withColumn("overlap", F.size(F.array_intersect("asked", X.content_terms(F.col("sentence"))))).filter("overlap > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "at")
    best = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sentences)
    first = best.withColumn("first", F.min("n").over(Window.partitionBy("query_id", "pmid")))
    return first.select("query_id", "n", "pmid", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first")).alias("source"), "sentence", F.col("overlap").cast("long").alias("overlap"))


def abstained(queries: DataFrame, answers: DataFrame, hits: DataFrame, *, nearest: int = 3) -> DataFrame:
    """(query_id, nearest) of questions without an answer: ids of their nearest documents by rank, empty if nothing was retrieved."""
    silent = queries.select("query_id").join(answers.select("query_id").distinct(), "query_id", "left_anti")
    near = hits.filter(F.col("rank") <= nearest).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pmid"))), lambda h: h["pmid"]).alias("nearest"))
    return silent.join(near, "query_id", "left").select("query_id", F.coalesce("nearest", F.array().cast("array<string>")).alias("nearest"))


def render(answers: DataFrame, *, marker_after: bool = False) -> DataFrame:
    """(query_id, text): sentences with the number of their source.

    The marker stands before a sentence's last punctuation, so that a verifier that cuts after it keeps both together;
    ``marker_after`` puts it behind, which moves it to the next sentence.
    """
    mark = F.concat(F.lit("["), F.col("source").cast("string"), F.lit("]"))
    before = F.concat(F.regexp_replace("sentence", r"[.!?]+$", ""), F.lit(" "), mark, F.coalesce(F.nullif(F.regexp_extract("sentence", r"([.!?]+)$", 1), F.lit("")), F.lit(".")))
    line = F.concat("sentence", F.lit(" "), mark) if marker_after else before
    rows = answers.select("query_id", F.struct("n", line.alias("line")).alias("s"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["line"]), " ").alias("text"))


def sources(answers: DataFrame) -> DataFrame:
    """(query_id, passages): cited ids in the order of their numbers."""
    each = answers.select("query_id", "source", "pmid").distinct()
    return each.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("source", "pmid"))), lambda s: s["pmid"]).alias("passages"))


def restated(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, text, passages): a template in a generator's place, which states each sentence of the question and cites the first document for it.

    Whether that document bears it out is for the verifier to say. A question without hits has no row.
    """
    end = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, r"([.!?]+)$", 1), F.lit("")), F.lit("."))
    cited = F.transform(X.sentences(F.col("question")), lambda s: F.concat(F.regexp_replace(s, r"[.!?]+$", ""), F.lit(" [1]"), end(s)))
    first = hits.filter("rank = 1").select("query_id", F.array("pmid").alias("passages"))
    return queries.select("query_id", F.array_join(cited, " ").alias("text")).join(first, "query_id")


def confidence(queries: DataFrame, hits: DataFrame, *, margin_k: int = 5) -> DataFrame:
    """(query_id, top_score, margin): the first score, and what it is above that of the last of the first ``margin_k``; 0 without hits."""
    top = hits.filter(F.col("rank") <= margin_k).groupBy("query_id").agg(F.min_by("score", "rank").alias("first"), F.max_by("score", "rank").alias("last"))
    return queries.select("query_id").join(top, "query_id", "left").select("query_id", F.coalesce("first", F.lit(0.0)).alias("top_score"), F.coalesce(F.col("first") - F.col("last"), F.lit(0.0)).alias("margin"))


def gate(confidences: DataFrame, *, min_score: float = 0.0, min_margin: float = 0.0) -> DataFrame:
    """Adds answerable: both thresholds are reached."""
    return confidences.withColumn("answerable", (F.col("top_score") >= min_score) & (F.col("margin") >= min_margin))


def calibration_records(queries: DataFrame, hits: DataFrame, qrels: DataFrame, *, k: int = 5) -> DataFrame:
    """(query_id, correct, confidence): whether a relevant document is among the first ``k``, and the margin."""
    good = hits.filter(F.col("rank") <= k).join(qrels, ["query_id", "pmid"], "left_semi").select("query_id").distinct().withColumn("correct", F.lit(True))
    return confidence(queries, hits, margin_k=k).join(good, "query_id", "left").select("query_id", F.coalesce("correct", F.lit(False)).alias("correct"), F.col("margin").alias("confidence"))


def risk_coverage(records: DataFrame, order: str = "seq") -> DataFrame:
    """(n, threshold, coverage, error_rate) of records (correct, confidence): a point for each, most confident first, ties by ``order``.

    The running error is global by nature; ``ranking.running`` sums ranges of the order first.
    """
    placed = running(records, [], [F.desc("confidence"), F.col(order)], {"n": F.lit(1), "wrong": (~F.col("correct")).cast("long")})
    rows = placed.crossJoin(F.broadcast(records.agg(F.count("*").alias("total"))))  # a single row
    return rows.select("n", F.col("confidence").alias("threshold"), (F.col("n") / F.col("total")).alias("coverage"), (F.col("wrong") / F.col("n")).alias("error_rate"))


def operating_point(curve: DataFrame, target: float) -> DataFrame:
    """The point whose coverage is nearest to ``target``, the first of equals; ValueError for a target that isn't above 0 and at most 1."""
    if not 0 < target <= 1:
        raise ValueError(f"a coverage of {target} isn't above 0 and at most 1")
    return curve.orderBy(F.round(F.abs(F.col("coverage") - target), 12), "n").limit(1)
