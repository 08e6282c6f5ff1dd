"""Retrieval metrics, misses, accuracy, weights and attribution."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import running

STAGES = ("retrieval", "reranking", "generation", "verification")


def _known(value: Column, n: Column, what: str) -> Column:
    """``value``, or a failure of the job where ``n`` rows are none."""
    return F.when(n > 0, value).otherwise(F.raise_error(F.lit(what)))


def metrics(hits: DataFrame, qrels: DataFrame, k_values=(5, 20, 100), mrr_k: int = 10, ndcg_k: int = 10) -> DataFrame:
    """One row of means over the queries that have relevant documents: n_queries, recall_at_*, mrr, ndcg.

    One ranking (query_id, pmid, rank), as deep as the deepest cutoff, serves all. Fails where no query has a relevant document.
    """
    wanted = qrels.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    good = hits.join(qrels, ["query_id", "pmid"], "left_semi")
    at = lambda k: F.coalesce(F.sum(F.when(F.col("rank") <= k, 1)), F.lit(0))
    found = good.groupBy("query_id").agg(
        *[at(k).alias(f"hit_{k}") for k in k_values],
        F.min(F.when(F.col("rank") <= mrr_k, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= ndcg_k, 1 / F.log2(F.col("rank") + 1))).alias("gain"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(ndcg_k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    each = wanted.join(found, "query_id", "left")
    return each.agg(
        _known(F.count("*"), F.count("*"), "no query has a relevant document").alias("n_queries"),
        *[F.avg(F.coalesce(F.col(f"hit_{k}"), F.lit(0)) / F.col("n_rel")).alias(f"recall_at_{k}") for k in k_values],
        F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.avg(F.coalesce(F.col("gain"), F.lit(0.0)) / ideal).alias("ndcg"),
    )


def misses(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant) of queries without a relevant document among their first ``k``."""
    good = hits.filter(F.col("rank") <= k).join(qrels, ["query_id", "pmid"], "left_semi").select("query_id")
    return qrels.groupBy("query_id").agg(F.count("*").alias("n_relevant")).join(good, "query_id", "left_anti")


def accuracy(predictions: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """One row: share of gold (key, label) that predictions (key, predicted) match, case aside; a missing one is wrong. Fails without gold."""
    right = F.lower(F.coalesce("predicted", F.lit(""))) == F.lower("label")
    return gold.join(predictions, key, "left").agg(_known(F.avg(right.cast("int")), F.count("*"), "no gold labels to score against").alias("accuracy"), F.count("*").alias("n"))


def label_shares(gold: DataFrame) -> DataFrame:
    """(label, n, majority): counts, and the share of the commonest label."""
    counted = gold.groupBy("label").agg(F.count("*").alias("n"))
    total = counted.agg((F.max("n") / F.sum("n")).alias("majority"))
    return counted.crossJoin(F.broadcast(total))  # one row


def class_weights(gold: DataFrame, classes: int) -> DataFrame:
    """(label, weight): total / (classes * count), for labels 0 to classes - 1; an absent one counts as 1."""
    every = gold.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    counted = gold.groupBy("label").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return every.join(counted, "label", "left").crossJoin(F.broadcast(total)).select("label", (F.col("total") / (classes * F.coalesce("n", F.lit(1)))).alias("weight"))


def attribution(fixes: DataFrame, stages=STAGES) -> DataFrame:
    """(stage, n, fraction): failures by the first stage whose oracle would have fixed them; stages without any have 0."""
    first = F.coalesce(*[F.when(F.col(s), F.lit(s)) for s in stages], F.lit("unattributed"))
    counted = fixes.groupBy(first.alias("stage")).agg(F.count("*").alias("n"))
    every = fixes.sparkSession.createDataFrame([(s,) for s in (*stages, "unattributed")], "stage string")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return every.join(counted, "stage", "left").crossJoin(F.broadcast(total)).select("stage", n.alias("n"), F.coalesce(n / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("fraction"))


def over_seeds(values: DataFrame) -> DataFrame:
    """(group, mean, std): the population's deviation."""
    return values.groupBy("group").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """(group, epoch, accuracy) of the best accuracy, the earliest of equals."""
    return epochs.groupBy("group").agg(F.max_by(F.struct("epoch", "accuracy"), F.struct("accuracy", -F.col("epoch"))).alias("b")).select("group", "b.epoch", "b.accuracy")


class StageTimer:
    """Wall-clock milliseconds of named stages on the driver, as samples(stage, ms) for ``latency``."""

    def __init__(self) -> None:
        self.samples: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.samples.append((name, (time.perf_counter() - began) * 1000))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.samples, "stage string, ms double")


def latency(samples: DataFrame, quantiles=(0.5, 0.95)) -> DataFrame:
    """(stage, count, p50, p95) by the value at place min(n - 1, floor(q * n)).

    Equal values are counted first, and numbered by ranges of (stage, ms), so that a stage may have any number of them.
    """
    counted = samples.groupBy("stage", "ms").agg(F.count("*").alias("m"))
    upto = running(counted, ["stage"], [F.col("ms")], {"upto": F.col("m")})
    total = samples.groupBy("stage").agg(F.count("*").alias("count"))
    at = lambda q: F.least(F.col("count") - 1, F.floor(F.lit(q) * F.col("count")))
    held = lambda q: F.max(F.when((F.col("upto") - F.col("m") <= at(q)) & (at(q) < F.col("upto")), F.col("ms")))
    rows = upto.join(total, upto["stage"].eqNullSafe(total["stage"])).select(upto["stage"], "ms", "m", "upto", "count")
    return rows.groupBy("stage", "count").agg(*[held(q).alias(f"p{round(q * 100)}") for q in quantiles])
