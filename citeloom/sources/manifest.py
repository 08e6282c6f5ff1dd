"""Ingest that resumes: a table of the files that were seen, joined with the folder, so that only new, changed or formerly corrupt ones are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.storage import settled

from . import articles
from .files import md5_of
from .store import DocumentStore, KeyedStore

SCHEMA = "file string, length long, modified timestamp, md5 string, expected string, state string"

#: States of a file.
DONE, CORRUPT = "done", "corrupt"


def baseline_name(number: int, *, release: str = "25", digits: int = 4) -> str:
    """The name of a yearly baseline's file."""
    return f"pubmed{release}n{number:0{digits}d}.xml.gz"


class Manifest(KeyedStore):
    """Files by their path: length, time, MD5, the MD5 that a companion file asks for, and whether they were ingested."""

    key = "file"

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, schema=SCHEMA)

    def pending(self, listed: DataFrame) -> DataFrame:
        """Rows of listed(file, length, modified) that aren't done as they are now."""
        done = self.table().filter(F.col("state") == DONE).select("file", "length", "modified")
        return listed.join(done, ["file", "length", "modified"], "left_anti")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified) of a folder's article files; their content isn't read."""
    found = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    return found.filter(F.col("file").rlike(articles._FILE.pattern))


def ingest_folder(spark: SparkSession, folder: str, store: DocumentStore, manifest: Manifest, *, domain_filter: bool = True) -> dict[str, int]:
    """Ingest the files of ``folder`` that the manifest doesn't have as done; counts of files and documents.

    A file with a companion ``.md5`` that it doesn't match is noted as corrupt and not parsed; it is tried again in the next run, as are files whose length or
    time changed. Files are noted once their documents are stored, so a run that dies is made up for by the next, whose upserts change nothing.
    """
    listed = settled(listing(spark, folder))
    todo = settled(manifest.pending(listed))
    n = todo.count()
    if not n:
        return {"files": listed.count(), "pending": 0, "corrupt": 0, "parsed": 0, "stored": 0}
    # Only the pending files are read: each task opens the paths that it is given.
    contents = spark.read.format("binaryFile").load([r["file"] for r in todo.select("file").collect()])  # names alone
    sums = spark.read.format("binaryFile").option("pathGlobFilter", "*.md5").load(folder)
    asked = sums.select(F.regexp_replace("path", r"\.md5$", "").alias("file"), md5_of(F.col("content").cast("string")).alias("expected"))
    checked = settled(contents.select(F.col("path").alias("file"), F.md5("content").alias("md5")).join(asked, "file", "left"))
    good = F.col("expected").isNull() | (F.col("expected") == F.col("md5"))
    fine = settled(checked.filter(good).select("file"))
    counts = {"parsed": 0, "stored": 0}
    if not fine.isEmpty():
        files = contents.join(fine.withColumnRenamed("file", "path"), "path", "left_semi").select(F.lit(0).alias("given"), "path", "content")
        counts = articles.ingest(spark, [], store, domain_filter=domain_filter, raw=articles.parsed(files))
    manifest.upsert(checked.join(todo, "file").select("file", "length", "modified", "md5", "expected", F.when(good, DONE).otherwise(CORRUPT).alias("state")))
    return {"files": listed.count(), "pending": n, "corrupt": checked.filter(~good).count(), "parsed": counts["parsed"], "stored": counts["stored"]}
