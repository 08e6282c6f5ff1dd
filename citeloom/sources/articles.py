"""Bibliographic XML: a data source of article files, plain or gzipped."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators.storage import replace, settled

from .store import DocumentStore

SCHEMA = "pmid string, title string, abstract string, year int, journal string, mesh_terms array<string>"

FIELDS = "pmid string, title string, sections array<string>, year_text string, medline string, journal string, languages array<string>, headings array<string>"

_FILE = re.compile(r"\.xml(\.gz)?$")


def _text(e: ElementTree.Element | None) -> str | None:
    return None if e is None else "".join(e.itertext())


def read_articles(stream: BinaryIO) -> Iterator[tuple]:
    """Raw fields of each article of an XML stream, plain or gzipped; elements go as soon as they are read, so a file of any length passes through."""
    start = stream.read(2)
    stream = _After(start, stream)
    parse = ElementTree.iterparse(gzip.open(stream) if start == b"\x1f\x8b" else stream, events=("start", "end"))
    root, at = None, 0
    for event, e in parse:
        if root is None:
            root = e
        if event == "start" or e.tag != "PubmedArticle":
            continue
        c = e.find("MedlineCitation")
        article = None if c is None else c.find("Article")
        if article is not None:
            date = article.find("Journal/JournalIssue/PubDate")
            yield (
                at,
                _text(c.find("PMID")),
                _text(article.find("ArticleTitle")),
                [_text(s) for s in article.findall("Abstract/AbstractText")],
                None if date is None else _text(date.find("Year")),
                None if date is None else _text(date.find("MedlineDate")),
                _text(article.find("Journal/Title")),
                [s.text or "" for s in article.findall("Language")],
                [_text(s) for s in c.findall("MeshHeadingList/MeshHeading/DescriptorName")],
            )
        at += 1
        if e is not root:
            root.clear()


class _After(io.RawIOBase):
    """A stream with the bytes that were read of it put back."""

    def __init__(self, start: bytes, rest: BinaryIO):
        self.start, self.rest = start, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if not self.start:
            return self.rest.read(n)
        head, self.start = (self.start, b"") if n is None or n < 0 else (self.start[:n], self.start[n:])
        return head + self.rest.read(n) if n is None or n < 0 else head


def raw_articles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw articles of files and folders; folders give their own ``.xml`` and ``.xml.gz`` files, by name, and files are taken whatever their names.

    Read through Spark, so any store it knows will do. ValueError where no file is found.
    """
    conf, fs_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files, any_file = None, False
    for i, p in enumerate(paths):
        where = fs_path(p)
        fs = where.getFileSystem(conf)
        folder = fs.exists(where) and fs.getFileStatus(where).isDirectory()
        any_file = any_file or not folder or any(_FILE.search(f.getPath().getName()) for f in fs.listStatus(where))
        part = spark.read.format("binaryFile").load(p).select(F.lit(i).alias("given"), "path", "content")
        part = part.filter(F.col("path").rlike(_FILE.pattern)) if folder else part
        files = part if files is None else files.unionByName(part)
    if not any_file:
        raise ValueError("no article files among the inputs")
    return parsed(files)


def parsed(files: DataFrame) -> DataFrame:
    """Raw articles of files(given, path, content)."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for given, path, content in pdf.itertuples(index=False):
                rows = [(given, path, *r) for r in read_articles(io.BytesIO(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["given", "path", "at", "pmid", "title", "sections", "year_text", "medline", "journal", "languages", "headings"])

    return files.mapInPandas(parse, f"given int, path string, at long, {FIELDS}")


def articles(raw: DataFrame, language: str = "eng") -> DataFrame:
    """Documents of raw articles that have an id, title and abstract and are in ``language``; seq orders them by file and place."""
    filled = lambda a: F.filter(F.transform(a, X.clean), lambda s: s != "")
    rows = raw.select(
        F.struct("given", "path", "at").alias("seq"),
        X.clean(F.col("pmid")).alias("pmid"),
        X.clean(F.col("title")).alias("title"),
        F.array_join(filled(F.col("sections")), " ").alias("abstract"),
        X.year(F.col("year_text"), F.col("medline")).alias("year"),
        F.nullif(X.clean(F.col("journal")), F.lit("")).alias("journal"),
        filled(F.col("headings")).alias("mesh_terms"),
        F.filter(F.transform("languages", lambda x: F.lower(X.strip(x))), lambda x: F.lit(True)).alias("tags"),
    )
    return rows.filter((F.col("pmid") != "") & (F.col("title") != "") & (F.col("abstract") != "") & X.is_language(F.col("tags"), language)).drop("tags")


def ingest(spark: SparkSession, paths: list[str], store: str | DocumentStore, *, domain_filter: bool = True, raw: DataFrame | None = None) -> dict[str, int]:
    """Parse, de-duplicate, keep documents in scope and upsert them; counts of each step.

    A store of base and deltas gets what is new alone; a path names a plain Parquet table, which is written anew. ``raw`` has the articles, if they were read already.
    """
    from pyspark.errors import AnalysisException

    from citeloom.operators.corpus import deduplicate, upsert

    found = settled(articles(raw_articles(spark, paths) if raw is None else raw))
    unique = deduplicate(found)
    kept = unique.filter(F.size(X.domains(F.col("mesh_terms"))) > 0) if domain_filter else unique
    kept = settled(kept)
    if isinstance(store, DocumentStore):
        store.upsert(kept.drop("seq"))
    else:
        new = kept.drop("seq").withColumn("seq", F.lit(1))
        try:
            old = settled(spark.read.parquet(store).withColumn("seq", F.lit(0)))
        except AnalysisException:
            old = new.limit(0)
        replace(upsert(old, new).drop("seq"), store)
    return {"parsed": found.count(), "unique": unique.count(), "in_domain": kept.count(), "stored": kept.count()}
