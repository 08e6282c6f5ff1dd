"""Ingest: greedy de-duplication, upserts, topics, statistics and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as X

from .storage import settled

OUT_OF_SCOPE = "out_of_scope"


def upsert(old: DataFrame, new: DataFrame, key: str = "pmid") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of repeated keys in ``new``, the largest seq."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch"), F.desc("seq")))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_batch")


def deduplicate(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Rows in order that repeat neither pmid nor title fingerprint of one that was kept before.

    A rejected row blocks neither key, so two passes would be wrong. Rounds: keep what comes first under both of
    its keys, drop what shares a key with it, until nothing is left. Where one key is unique already, a single pass over the
    other does the same.
    """
    left = rows.withColumn("_fp", X.title_fingerprint(F.col("title")))
    if left.count() == left.select("pmid").distinct().count():
        first = left.groupBy("_fp").agg(F.min(F.struct(order, "pmid")).alias("_m"))
        return left.join(first, "_fp").filter(F.struct(order, "pmid") == F.col("_m")).drop("_m", "_fp").select(*rows.columns)
    kept = None
    while not left.isEmpty():
        # Minima are combined before they are dealt by key, so a very common key (the empty fingerprint) is no row count of one task.
        first = lambda key, out: left.groupBy(key).agg(F.min(order).alias(out))
        both = left.join(first("pmid", "_a"), "pmid").join(first("_fp", "_b"), "_fp")
        winners = settled(both.filter((F.col(order) == F.col("_a")) & (F.col(order) == F.col("_b"))).select(*left.columns))
        kept = winners if kept is None else kept.unionByName(winners)
        left = settled(left.join(winners.select("pmid"), "pmid", "left_anti").join(winners.select("_fp"), "_fp", "left_anti"))
    return (left if kept is None else kept).drop("_fp")


def scope_counts(docs: DataFrame, found: Column, names: list[str]) -> DataFrame:
    """(domain, n) of an array column of topics; topics without documents have 0, documents without topics are out of scope."""
    each = docs.select(F.explode(F.when(F.size(found) == 0, F.array(F.lit(OUT_OF_SCOPE))).otherwise(found)).alias("domain"))
    counted = each.groupBy("domain").agg(F.count("*").alias("n"))
    every = docs.sparkSession.createDataFrame([(n,) for n in [*sorted(names), OUT_OF_SCOPE]], "domain string")
    return every.join(counted, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def word_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(X.word_count(F.col("abstract"))), F.lit(0)).alias("total_words"), F.coalesce(F.avg(X.word_count(F.col("abstract"))), F.lit(0.0)).alias("mean_words"))


def year_histogram(docs: DataFrame) -> DataFrame:
    """(year, n); unknown years are a row with null."""
    return docs.groupBy("year").agg(F.count("*").alias("n"))


def top_journals(docs: DataFrame, n: int) -> DataFrame:
    """(journal, n): most documents first, ties by the smallest pmid; unknown journals don't count."""
    counted = docs.filter(F.col("journal").isNotNull()).groupBy("journal").agg(F.count("*").alias("n"), F.min("pmid").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select("journal", "n")


def report(docs: DataFrame, title: str = "Corpus", *, journals: int = 10) -> str:
    """Markdown of the statistics, whose tables are small: counts, topics, years (unknown ones last) and the journals of most documents."""
    words = word_stats(docs).first()
    out = [f"# {title}", "", f"- documents: {words['n_docs']}", f"- words: {words['total_words']}", f"- mean words: {words['mean_words']:.1f}"]

    def section(heads: tuple[str, str], rows: list[tuple]) -> None:
        out.extend(["", f"| {heads[0]} | {heads[1]} |", "|---|---|", *[f"| {a} | {n} |" for a, n in rows]])

    if "mesh_terms" in docs.columns:
        topics = scope_counts(docs, X.domains(F.col("mesh_terms")), list(X.DOMAIN_KEYWORDS))
        section(("domain", "documents"), [(r["domain"], r["n"]) for r in topics.orderBy(F.col("domain") == OUT_OF_SCOPE, "domain").collect()])
    section(("year", "documents"), [("unknown" if r["year"] is None else r["year"], r["n"]) for r in year_histogram(docs).orderBy(F.asc_nulls_last("year")).collect()])
    section(("journal", "documents"), [(r["journal"], r["n"]) for r in top_journals(docs, journals).collect()])
    return "\n".join(out) + "\n"


def split(rows: DataFrame, salt: str, dev_percent: int = 50, key: str = "query_id") -> DataFrame:
    """Adds bucket (0 to 99) and part ('dev' or 'test'), by a salted hash of the key alone."""
    bucket = X.hash_bucket(salt, F.col(key))
    return rows.withColumn("bucket", bucket).withColumn("part", F.when(bucket < dev_percent, "dev").otherwise("test"))


def passages_within(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, pmid) of documents (pmid, text) that hold a passage (query_id, question) verbatim.

    A passage's inner words stand in such a document between the same white space. Its longest one is the key of an equi-join; what it
    finds is then compared as a whole. Passages of less than three words have no inner word and meet all documents.
    """
    parts = X.words(F.col("question"))
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    key = F.reduce(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    keyed = passages.select("query_id", "question", key.alias("key"))
    words = docs.select("pmid", F.explode(F.array_distinct(X.words(F.col("text")))).alias("key"))
    found = words.join(keyed.filter("key <> ''"), "key").select("query_id", "question", "pmid")
    held = found.join(docs.select("pmid", "text"), "pmid").filter(F.contains("text", "question")).select("query_id", "pmid")
    short = keyed.filter("key = ''").join(docs, F.contains(docs["text"], F.col("question"))).select("query_id", "pmid")
    return held.unionByName(short)
