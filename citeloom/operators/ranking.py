"""Ranks, caps and fused rankings. Rank is a column, never a row's place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settled


def comparable(score: Column) -> Column:
    """Scores to nine places: sums in another order differ beyond them, and are ties."""
    return F.round(score, 9)


def top(scored: DataFrame, k: int, *, group: str = "query_id", item: str = "pmid", score: str = "score") -> DataFrame:
    """The ``k`` best of each group with rank from 1, ties to the smaller item."""
    w = Window.partitionBy(group).orderBy(comparable(F.col(score)).desc(), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, the row's own value included, along ``order`` within each combination of ``keys``.

    Rows are cut into ranges of (keys, order), which are stored; the ranges' sums, one row for each range and key, say where each begins, and
    a window goes over one range at a time. So neither all rows nor those of a key meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    names = {name: f"_{name}" for name in sums}
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(names[n]) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in names.values()])
    so_far = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(c).over(so_far).alias(n) for n, c in sums.items()])
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return summed.join(starts, same).select(*rows.columns, *[(F.col(n) + F.col(v)).alias(n) for n, v in names.items()])


def first_rows(rows: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by ``order``; all without a cap."""
    return rows if n is None else rows.orderBy(order).limit(n)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, *, constant: int = 60, depth: int = 100) -> DataFrame:
    """Merge rankings (query_id, pmid, rank from 1) by the sum of 1 / (constant + rank), each to ``depth``."""
    if not rankings:
        raise ValueError("fusion needs at least one ranking")
    parts = reduce(DataFrame.unionByName, [r.filter(F.col("rank") <= depth).select("query_id", "pmid", (1.0 / (constant + F.col("rank"))).alias("part")) for r in rankings])
    return top(parts.groupBy("query_id", "pmid").agg(F.sum("part").alias("score")), k)


def rerank(base: DataFrame, k: int, *, candidates: int = 100, weight: float = 0.0, constant: int = 60) -> DataFrame:
    """Order candidates (query_id, pmid, rank from 1, rerank_score) anew: by rerank score alone, or fused with the base rank.

    Ranks in the fusion count from 0. The score of a hit stays its rerank score, so that order and score may differ.
    """
    part = base.filter(F.col("rank") <= candidates).withColumn("base_rank", F.col("rank") - 1)
    by_score = Window.partitionBy("query_id").orderBy(comparable(F.col("rerank_score")).desc(), "base_rank", "pmid")
    ranked = part.withColumn("rerank_rank", F.row_number().over(by_score) - 1)
    fused = weight / (constant + F.col("base_rank")) + 1.0 / (constant + F.col("rerank_rank"))
    w = Window.partitionBy("query_id").orderBy(comparable(fused).desc(), "base_rank", "pmid")
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "pmid", "rank", F.col("rerank_score").alias("score"))
