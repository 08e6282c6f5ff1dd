"""Training rows for retrievers, rerankers, verifiers and tokenizer statistics; and scorers trained with Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

from .ranking import running


def distinct_pairs(triples: DataFrame) -> DataFrame:
    """(query, positive, seq): distinct pairs with the place where each came first."""
    return triples.groupBy("query", "positive").agg(F.min("seq").alias("seq"))


def labelled_pairs(triples: DataFrame) -> DataFrame:
    """(query, text, label): of each triple the positive with 1 and each negative (one, or an array) with 0."""
    negatives = F.col("negative") if dict(triples.dtypes)["negative"].startswith("array") else F.array("negative")
    item = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    rows = F.concat(F.array(item(F.col("positive"), 1)), F.transform(negatives, lambda n: item(n, 0)))
    return triples.select("query", F.inline(rows))


def distinct_texts(*texts: DataFrame) -> DataFrame:
    """(text): what a model is pretrained on: the different texts of all tables (text), without null and empty ones."""
    return reduce(DataFrame.unionByName, [t.select("text") for t in texts]).filter("text <> ''").distinct()


def title_pairs(docs: DataFrame) -> DataFrame:
    return docs.filter((F.col("title") != "") & (F.col("abstract") != "")).select("pmid", F.col("title").alias("anchor"), F.col("abstract").alias("positive"))


def halves(docs: DataFrame, least: int = 8) -> DataFrame:
    """(pmid, anchor, positive): both halves of abstracts of at least ``least`` words."""
    rows = docs.select("pmid", X.words(F.col("abstract")).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    both = F.struct(F.array_join(F.slice("w", F.lit(1), half), " ").alias("anchor"), F.array_join(F.slice("w", half + 1, F.size("w")), " ").alias("positive"))
    return rows.select("pmid", F.inline(F.when(F.size("w") >= least, F.array(both)).otherwise(F.array().cast("array<struct<anchor:string,positive:string>>"))))  # a filter would cut words again


def hard_negatives(rankings: list[DataFrame], positives: DataFrame, *, n: int = 4, pool: int = 20) -> DataFrame:
    """(query_id, place, pmid): for each query the first ``n`` documents of the rankings, one ranking after another, that aren't its positive."""
    pools = None
    for i, r in enumerate(rankings):
        part = r.filter(F.col("rank") <= pool).select("query_id", "pmid", "rank", F.lit(i).alias("source"))
        pools = part if pools is None else pools.unionByName(part)
    others = pools.join(positives, ["query_id", "pmid"], "left_anti").join(positives.select("query_id").distinct(), "query_id", "left_semi")
    first = others.groupBy("query_id", "pmid").agg(F.min(F.struct("source", "rank")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    return first.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "place", "pmid")


def grounded_examples(queries: DataFrame, hits: DataFrame, docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, question, passages, answer): passages are (pmid, chunk) by rank, without hits that have no document."""
    found = hits.join(docs.select("pmid", X.chunk(F.col("title"), F.col("abstract")).alias("chunk")), "pmid")
    gathered = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "pmid", "chunk"))), lambda s: F.struct(s["pmid"].alias("pmid"), s["chunk"].alias("chunk"))).alias("passages"))
    return queries.join(gathered, "query_id").join(answers.select("query_id", F.col("text").alias("answer")), "query_id")


def pad_batches(rows: DataFrame, *, batch: str, ids: str, max_length: int, pad_id: int = 0) -> DataFrame:
    """Adds padded and mask: ids cut to ``max_length`` and filled up to the longest of the batch."""
    cut = F.slice(ids, 1, max_length)
    width = F.max(F.size(cut)).over(Window.partitionBy(batch))
    return rows.withColumn("width", width).withColumn("padded", X.pad(cut, F.col("width"), pad_id)).withColumn("mask", X.pad(F.transform(cut, lambda _: F.lit(1)), F.col("width"), 0)).drop("width")


def word_budget(texts: DataFrame, budget: float, order: str = "seq") -> DataFrame:
    """Texts in order of a column of any kind, as long as those before them have less than ``budget`` words.

    Counts are summed by ranges of the order first, so that no more than a row for each range meets in one place.
    """
    counted = texts.withColumn("_n", X.word_count(F.coalesce("text", F.lit(""))))
    return running(counted, [], [F.col(order)], {"_upto": F.col("_n")}).filter(F.col("_upto") - F.col("_n") < budget).select(*texts.columns)


def mix(domain: DataFrame, general: DataFrame, ratio: float = 0.7) -> DataFrame:
    """(part, seq, text): all domain texts, and general ones until their words are (1 - ratio) of the whole; ValueError for a ratio that isn't above 0 and at most 1."""
    if not 0 < ratio <= 1:
        raise ValueError(f"a ratio of {ratio} isn't above 0 and at most 1")
    words = domain.agg(F.coalesce(F.sum(X.word_count(F.col("text"))), F.lit(0))).first()[0]
    budget = words * (1 - ratio) / ratio
    return domain.select(F.lit("domain").alias("part"), "seq", "text").unionByName(word_budget(general, budget).select(F.lit("general").alias("part"), "seq", "text"))


def fertility(texts: DataFrame, tokens: Column) -> DataFrame:
    """One row: tokens for each word over all texts with words; fails where there are none."""
    n = X.word_count(F.col("text"))
    sums = texts.filter(n > 0).agg(F.sum(F.size(tokens)).alias("tokens"), F.sum(n).alias("words"))
    return sums.select("tokens", "words", F.when(F.coalesce("words", F.lit(0)) > 0, F.col("tokens") / F.col("words")).otherwise(F.raise_error(F.lit("no words to measure fertility on"))).alias("fertility"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): what a BPE trainer starts from."""
    return texts.select(F.explode(X.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pair_features(rows: DataFrame) -> DataFrame:
    """Adds features of (query, text) for trained scorers: shared content terms, their share, and lengths."""
    asked, said = X.content_terms(F.col("query")), X.content_terms(F.col("text"))
    both = F.size(F.array_intersect(asked, said))
    return rows.withColumn("shared", both.cast("double")).withColumn("share", F.coalesce(both / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))).withColumn("asked", F.size(asked).cast("double")).withColumn("said", F.log1p(F.size(said)))


def train_scorer(rows: DataFrame, *, weights: str | None = None, max_iter: int = 50):
    """A logistic regression of label (two classes or more) on pair_features, as a pipeline model that can be saved and loaded."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    lr = LogisticRegression(maxIter=max_iter, regParam=1e-3, **({"weightCol": weights} if weights else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=["shared", "share", "asked", "said"], outputCol="features"), lr]).fit(pair_features(rows))
