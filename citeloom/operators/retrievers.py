"""Retrievers with one interface, and the factory that puts them together."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X

from . import bm25, ranking, vectors
from .storage import fingerprint, settled, shared_dir

T = TypeVar("T")

#: Format of kept vector indexes.
FORMAT_VERSION = 1

KINDS, ANN_KINDS = ("bm25", "dense", "hybrid"), ("exact", "ivf", "hnsw")


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, pmid, score) of the ``k`` best documents for each question of queries(query_id, question)."""


class VectorIndex(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, pmid, score, rank) of the ``k`` nearest for each of queries(query_id, vector)."""


@dataclass
class _Searched:
    """A vector index by a function of queries and k."""

    find: Callable[[DataFrame, int], DataFrame]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.find(queries, k)


def _kept(spark: SparkSession, path: str | None, about: dict, build: Callable[[str], T], load: Callable[[str], T]) -> T:
    """The index that ``build`` made under ``path`` for just this ``about``, made first if there is none.

    Its folder is named by what it was made of, so that one of other documents, another analyzer or encoder is never taken for it. A note
    that is written last tells a whole one. Without a path it lives in the shared folder.
    """
    folder = f"{path or shared_dir(spark) + '/citeloom'}/{about['kind']}-{hashlib.sha256(json.dumps(about, sort_keys=True).encode()).hexdigest()[:24]}"
    try:
        spark.read.text(f"{folder}/made").first()
    except AnalysisException:
        build(folder)
        spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/made")
    return load(folder)


def vector_index(kind: str, points: DataFrame, *, probes: int | None = None, path: str | None = None, shard_rows: int = 5000) -> VectorIndex:
    """An index of points(pmid, vector): 'exact', 'ivf' (round(sqrt(rows)) trained cells) or 'hnsw' (stored graphs).

    The last two are kept under ``path``, for these very points. Without ``probes`` a query looks at as many cells or shards as a sample of the points
    needed to find 0.95 of its true hits or more.
    """
    if kind == "exact":
        return _Searched(lambda queries, k: vectors.block_top(queries, points, k))
    if kind not in ANN_KINDS:
        raise ValueError(f"unknown vector index {kind}; there are {', '.join(ANN_KINDS)}")
    points, spark = settled(points.select("pmid", "vector")), points.sparkSession
    h = F.xxhash64("pmid", "vector")
    about = {"kind": kind, "format": FORMAT_VERSION, "points": [str(v) for v in points.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()], "shard_rows": shard_rows}
    if kind == "hnsw":
        graph = _kept(spark, path, about, lambda folder: vectors.Graph.build(points, folder, shard_rows=shard_rows), lambda folder: vectors.Graph.load(spark, folder))
        return _Searched(lambda queries, k: graph.search(queries, k, probes=probes))
    index = _kept(spark, path, about, lambda folder: vectors.InvertedFile.train(points).save(folder), lambda folder: vectors.InvertedFile.load(spark, folder))
    return _Searched(lambda queries, k: index.search(queries, k, probes))


def ann_curve(kind: str, points: DataFrame, queries: DataFrame, probes: list[int], *, k: int = 10, path: str | None = None) -> DataFrame:
    """(probes, recall, ms): share of the true ``k`` nearest of queries(query_id, vector) that an index finds, and its milliseconds a query, by what it looks at."""
    truth, n = settled(vectors.block_top(queries, points, k)), max(1, queries.count())
    rows = []
    for p in probes:
        index = vector_index(kind, points, probes=p, path=path)
        began = time.perf_counter()
        found = settled(index.search(queries, k))
        rows.append((p, (time.perf_counter() - began) * 1000 / n, vectors.recall(found, truth, k)))
    return points.sparkSession.createDataFrame([(p, r.first()[0], ms) for p, ms, r in rows], "probes int, recall double, ms double")


@dataclass
class Lexical:
    index: bm25.Index
    k1: float = bm25.K1
    b: float = bm25.B

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return bm25.search(self.index, queries, k, k1=self.k1, b=self.b)


@dataclass
class Dense:
    """``encode`` makes (pmid, vector) of (pmid, text), for documents and questions alike."""

    index: VectorIndex
    encode: Callable[[DataFrame], DataFrame]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = self.encode(queries.select(F.col("query_id").alias("pmid"), F.col("question").alias("text")))
        return self.index.search(asked.select(F.col("pmid").alias("query_id"), "vector"), k).select("query_id", "rank", "pmid", "score")


@dataclass
class Hybrid:
    parts: list[Retriever]
    depth: int = 100
    constant: int = 60

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        found = [p.search(queries, self.depth) for p in self.parts]
        return ranking.reciprocal_rank_fusion(found, k, constant=self.constant, depth=self.depth).select("query_id", "rank", "pmid", "score")


def overlap(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds rerank_score to hits: the share of the question's content terms that the document has. Terms are taken of hit documents alone."""
    found = docs.select("pmid", "title", "abstract").join(hits.select("pmid").distinct(), "pmid", "left_semi")
    held = found.select("pmid", X.content_terms(X.chunk(F.col("title"), F.col("abstract"))).alias("da"))
    asked = queries.select("query_id", X.content_terms(F.col("question")).alias("qa")).filter(F.size("qa") > 0)
    return hits.join(held, "pmid").join(asked, "query_id").withColumn("rerank_score", F.size(F.array_intersect("qa", "da")) / F.size("qa")).drop("qa", "da")


@dataclass
class Reranked:
    """The first ``candidates`` of ``base``, ordered by ``scorer`` (hits, documents, questions), fused with the base rank by ``weight``."""

    base: Retriever
    docs: DataFrame
    candidates: int = 100
    weight: float = 0.0
    scorer: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = overlap

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        scored = self.scorer(self.base.search(queries, self.candidates), self.docs, queries)
        return ranking.rerank(scored, k, candidates=self.candidates, weight=self.weight).select("query_id", "rank", "pmid", "score")


def lexical_index(docs: DataFrame, path: str | None = None) -> bm25.Index:
    """The index of these very documents under ``path``, written there first if there is none; one of this session only without a path."""
    if path is None:
        return bm25.Index.build(docs)
    about = {"kind": "bm25", "format": bm25.FORMAT_VERSION, "docs": fingerprint(docs.select("pmid", "title", "abstract")), "analyzer": "terms"}
    return _kept(docs.sparkSession, path, about, lambda folder: bm25.Index.build(docs).save(folder), lambda folder: bm25.Index.load(docs.sparkSession, folder))


def build(kind: str, docs: DataFrame, *, index: str | None = None, ann: str = "exact", probes: int | None = None, rerank: bool = False, weight: float = 0.0, k1: float = bm25.K1, b: float = bm25.B, encode: Callable[[DataFrame], DataFrame] = vectors.embed) -> Retriever:
    """A retriever of docs(pmid, title, abstract): 'bm25', 'dense' or 'hybrid'. ``index`` is a folder of saved indexes, ``ann`` the kind of vector index."""
    if kind not in KINDS:
        raise ValueError(f"unknown retriever {kind}; there are {', '.join(KINDS)}")
    if ann not in ANN_KINDS:
        raise ValueError(f"unknown vector index {ann}; there are {', '.join(ANN_KINDS)}")
    parts: list[Retriever] = []
    if kind != "dense":
        parts.append(Lexical(lexical_index(docs, index), k1, b))
    if kind != "bm25":
        chunks = docs.select("pmid", X.chunk(F.col("title"), F.col("abstract")).alias("text"))
        parts.append(Dense(vector_index(ann, encode(chunks), probes=probes, path=index), encode))
    found = parts[0] if len(parts) == 1 else Hybrid(parts)
    return Reranked(found, docs, weight=weight) if rerank else found
