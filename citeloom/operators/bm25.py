"""BM25 over an inverted index of three tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as X

from .ranking import top
from .storage import settled

K1, B = 1.5, 0.75

#: Format of a saved index.
FORMAT_VERSION = 1

#: So many distinct terms of questions at most are sent to the scan as a filter.
FEW_TERMS = 500


def postings(docs: DataFrame, analyze=X.terms) -> DataFrame:
    """(pmid, term, tf) of docs(pmid, title, abstract)."""
    found = docs.select("pmid", F.explode(analyze(X.chunk(F.col("title"), F.col("abstract")))).alias("term"))
    return found.groupBy("pmid", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, analyze=X.terms) -> DataFrame:
    """(pmid, dl); documents without terms count as well."""
    return docs.select("pmid", F.size(analyze(X.chunk(F.col("title"), F.col("abstract")))).cast("long").alias("dl"))


def totals(doc_lengths: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl (0 for no documents)."""
    return doc_lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(df: Column, n_docs: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _totals(counted: DataFrame, post: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl, of counted(n_docs) and of rows with tf that hold all terms."""
    size = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))
    return counted.crossJoin(size).select("n_docs", F.coalesce(F.col("terms") / F.nullif(F.col("n_docs"), F.lit(0)), F.lit(0.0)).alias("avgdl"))  # single rows


def _weighed(post: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, idf) of postings."""
    df = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))  # a single row
    return df.select("term", "df", idf(F.col("df"), F.col("n_docs")).alias("idf"))


@dataclass
class Index:
    """postings(pmid, term, tf, dl), terms(term, df, idf), and totals(n_docs, avgdl), which is one row.

    Write them with ``save``, and search the index that it returns, or that ``load`` reads, as often as you like: ``postings`` is then
    clustered by term, so that a few questions read a few row groups.
    """

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    counted: DataFrame | None = None  # one row: n_docs, which needs no texts

    @classmethod
    def build(cls, docs: DataFrame, analyze=X.terms) -> Index:
        # Dealt by document, the texts move once and their terms are counted where they are; dl follows from pmid.
        found = docs.select("pmid", "title", "abstract").repartition("pmid").select("pmid", analyze(X.chunk(F.col("title"), F.col("abstract"))).alias("ts"))
        sized = found.select("pmid", F.size("ts").cast("long").alias("dl"), "ts")
        post = sized.select("pmid", "dl", F.explode("ts").alias("term")).groupBy("pmid", "term", "dl").agg(F.count("*").alias("tf"))
        total = totals(sized.select("dl"))
        df = post.groupBy("term").agg(F.count("*").alias("df"))
        return cls(post, df.crossJoin(F.broadcast(total)).select("term", "df", idf(F.col("df"), F.col("n_docs")).alias("idf")), total, docs.agg(F.count("*").alias("n_docs")))

    @classmethod
    def asked(cls, docs: DataFrame, queries: DataFrame, analyze=X.terms) -> Index:
        """What ``queries`` need of the index, by one pass over the texts: the postings of their terms, and totals of all documents. Searches for them give the same as on the whole.

        A document keeps its terms that are asked for, and the number of all others in one row, so that nothing else of its text moves.
        """
        wanted = settled(queries.select(F.explode(F.array_distinct(analyze(F.col("question")))).alias("term")).distinct().select("term", F.lit(True).alias("wanted")))
        cut = docs.select("pmid", analyze(X.chunk(F.col("title"), F.col("abstract"))).alias("ts"))
        each = cut.select("pmid", F.size("ts").cast("long").alias("dl"), F.explode_outer("ts").alias("term"))  # the plain form would filter by terms that it cuts again
        kept = each.join(wanted, "term", "left").groupBy("pmid", "dl", F.when(F.col("wanted"), F.col("term")).alias("own")).agg(F.count("term").alias("tf"))
        kept = settled(kept)
        post = kept.filter("own IS NOT NULL").select("pmid", F.col("own").alias("term"), "tf", "dl")
        total = settled(_totals(docs.agg(F.count("*").alias("n_docs")), kept))
        return cls(post, settled(_weighed(post, total)), total)

    def save(self, path: str) -> Index:
        """Write the tables, each from those before it, and return the index that reads them."""
        spark = self.totals.sparkSession
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        post = spark.read.parquet(f"{path}/postings")
        total = self.totals if self.counted is None else _totals(self.counted, post)
        total.write.mode("overwrite").parquet(f"{path}/totals")
        total = spark.read.parquet(f"{path}/totals")
        _weighed(post, total).write.mode("overwrite").parquet(f"{path}/terms")
        spark.range(1).select(F.lit(FORMAT_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/format")
        return Index.load(spark, path)

    @classmethod
    def load(cls, spark, path: str) -> Index:
        """The saved index; ValueError if it was written in another format."""
        version = spark.read.parquet(f"{path}/format").first()["version"]
        if version != FORMAT_VERSION:
            raise ValueError(f"{path} has format {version}, not {FORMAT_VERSION}; build the index anew")
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "totals")))


def scores(index: Index, queries: DataFrame, *, k1: float = K1, b: float = B, analyze=X.terms) -> DataFrame:
    """(query_id, pmid, score) of all documents that have a term of the question, over its distinct terms; what ``search`` ranks without making it.

    Of a few questions (FEW_TERMS distinct terms at most) the terms are pushed down to the scan of the postings.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(analyze(F.col("question")))).alias("term"))
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    post = index.postings if len(few) > FEW_TERMS else index.postings.filter(F.col("term").isin(few))
    weighed = asked.join(index.terms.select("term", "idf"), "term")
    found = post.join(weighed, "term").crossJoin(F.broadcast(index.totals.select("avgdl")))  # a single row
    tf, norm = F.col("tf"), 1 - b + b * F.col("dl") / F.col("avgdl")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * norm)
    return found.groupBy("query_id", "pmid").agg(F.sum(part).alias("score"))


#: Documents of a shard, at most about, and at least where there are fewer shards than cores.
SHARD_DOCS, SMALL_SHARD = 50_000, 1000

_FOUND = pa.schema([("query_id", pa.string()), ("pmid", pa.string()), ("score", pa.float64())])


def best_of_shard(post: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """Of post(pmid, term, part) the ``k`` best documents of each question of asked(query_id, term, idf), ties to the smaller id, with their scores to nine places.

    A question's terms are added up from the largest bound (idf times the largest part of the term here) to the smallest. As soon as the bounds that are left
    can't lift a document to the k-th best sum so far, the rest is looked up for the others alone.
    """
    if not post.num_rows or not asked.num_rows:
        return _FOUND.empty_table()
    ids = pc.unique(post.column("pmid")).sort()
    doc = pc.index_in(post.column("pmid").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = pc.unique(post.column("term"))
    code = pc.index_in(post.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
    order = np.lexsort((doc, code))
    doc, part = doc[order], post.column("part").to_numpy()[order]
    starts = np.searchsorted(code[order], np.arange(len(terms) + 1))
    most = np.maximum.reduceat(part, starts[:-1])
    asked = asked.sort_by([("query_id", "ascending"), ("term", "ascending")])
    at = pc.index_in(asked.column("term").combine_chunks(), value_set=terms).fill_null(-1).to_numpy()
    weight, names = asked.column("idf").to_numpy(), asked.column("query_id").combine_chunks().dictionary_encode()
    edges = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1, append=len(names.dictionary)))
    out: list[tuple[str, np.ndarray, np.ndarray]] = []
    for begin, end in zip(edges[:-1], edges[1:]):
        here = np.flatnonzero(at[begin:end] >= 0) + begin
        bound = weight[here] * most[at[here]]
        here, bound = here[np.argsort(-bound, kind="stable")], np.sort(bound)[::-1]
        left = np.concatenate([np.cumsum(bound[::-1])[::-1], [0.0]])
        score, alive, least = np.zeros(len(ids)), None, 0.0
        for i, h in enumerate(here):
            d, v = doc[starts[at[h]] : starts[at[h] + 1]], part[starts[at[h]] : starts[at[h] + 1]]
            if alive is None and i and len(ids) > k and left[i] < score.max():
                least = np.partition(score, -k)[-k]
                if left[i] < least - _NEAR:
                    alive = np.flatnonzero(score + left[i] >= least - _NEAR)
            if alive is None:
                score[d] += weight[h] * v
            else:
                place = np.minimum(np.searchsorted(d, alive), len(d) - 1)
                held = d[place] == alive
                score[alive[held]] += weight[h] * v[place[held]]
        found = np.flatnonzero(score > 0) if alive is None else alive  # in the order of ids, which a stable sort keeps among equals
        ranked = np.round(score[found], 9)
        if len(found) > k:
            near = np.flatnonzero(ranked >= np.partition(ranked, -k)[-k])
            near = near[np.argsort(-ranked[near], kind="stable")[:k]]
            found, ranked = found[near], ranked[near]
        out.append((names.dictionary[names.indices[int(begin)].as_py()].as_py(), found, ranked))
    sizes = [len(f) for _, f, _ in out]
    where = np.concatenate([f for _, f, _ in out]) if out else np.zeros(0, np.int64)
    return pa.table([pa.array(np.repeat(np.array([q for q, _, _ in out], object), sizes), pa.string()), ids.take(pa.array(where)), pa.array(np.concatenate([s for *_, s in out]) if out else [], pa.float64())], schema=_FOUND)


#: Sums of documents are compared with what this leaves to rounding.
_NEAR = 1e-8


def search(index: Index, queries: DataFrame, k: int = 10, *, k1: float = K1, b: float = B, analyze=X.terms) -> DataFrame:
    """(query_id, rank, pmid, score) of the ``k`` best, ties to the smaller id.

    Postings of the questions' terms are dealt to shards of about SHARD_DOCS documents by a hash of the id, and the questions to each; a shard sends on
    its own ``k`` best, by ``best_of_shard``. The result is that of ranking all ``scores``.
    """
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.explode(F.array_distinct(analyze(F.col("question")))).alias("term"))
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    totals_ = index.totals.first()
    post = index.postings.filter(F.col("term").isin(few)) if len(few) <= FEW_TERMS else index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    n = totals_["n_docs"]
    shards = max(1, -(-n // SHARD_DOCS), min(queries.sparkSession.sparkContext.defaultParallelism, -(-n // SMALL_SHARD)))
    tf, norm = F.col("tf"), 1 - b + b * F.col("dl") / F.lit(totals_["avgdl"] or 1.0)
    left = post.select(F.pmod(F.xxhash64("pmid"), F.lit(shards)).cast("int").alias("shard"), "pmid", "term", (tf * (k1 + 1) / (tf + k1 * norm)).alias("part"))
    right = asked.join(index.terms.select("term", "idf"), "term").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("q_shard"), "query_id", "term", "idf")
    found = left.groupBy("shard").cogroup(right.groupBy("q_shard")).applyInArrow(lambda x, q: best_of_shard(x, q, k), "query_id string, pmid string, score double")
    return top(found, k).select("query_id", "rank", "pmid", "score")


def resolve(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with title and abstract of their documents; null where there is none."""
    return hits.join(docs.select("pmid", "title", "abstract"), "pmid", "left")
