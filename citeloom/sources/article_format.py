"""A Spark data source of article files: ``spark.read.format("articles")`` and ``spark.readStream.format("articles")`` after ``register``.

A partition is a file, which streams through the parser; the rows are those of ``articles.raw_articles``. Paths are what Arrow's file systems know
(local files, hdfs, s3, gs); for a store that only Spark's own readers reach there is ``articles.raw_articles``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .articles import _FILE, FIELDS, read_articles

SCHEMA = f"given int, path string, at long, {FIELDS}"

#: Articles of a batch.
BATCH = 500


@dataclass
class File(InputPartition):
    given: int
    path: str


def files_of(paths: list[str]) -> list[File]:
    """Files in the order they are given; folders give their own ``.xml`` and ``.xml.gz`` files by name. ValueError where there is none."""
    out = []
    for i, path in enumerate(paths):
        fs, where = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        info = fs.get_file_info(where)
        prefix = path[: len(path) - len(where)] if path.endswith(where) else ""
        if info.type == pafs.FileType.Directory:
            found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(where)) if f.is_file and _FILE.search(f.base_name))
            out += [File(i, prefix + f) for f in found]
        elif info.type == pafs.FileType.File:
            out.append(File(i, path))
    if not out:
        raise ValueError("no article files among the inputs")
    return out


def batches(file: File, schema: pa.Schema, wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
    fs, where = pafs.FileSystem.from_uri(file.path) if "://" in file.path else (pafs.LocalFileSystem(), file.path.removeprefix("file:"))
    rows: list[tuple] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
    with fs.open_input_stream(where, compression=None) as stream:
        for article in read_articles(stream):
            if wanted is None or (article[1] or "").strip() in wanted:
                rows.append((file.given, file.path, *article))
            if len(rows) == BATCH:
                yield pack()
                rows = []
    if rows:
        yield pack()


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.schema, self.wanted, self.named = paths, to_arrow_schema(schema), None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ids and paths that a query asks for are looked at before rows are made; Spark still checks all."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("pmid",):
                self.wanted = values if self.wanted is None else self.wanted & values
            if values is not None and f.attribute == ("path",):
                self.named = values if self.named is None else self.named & values
            yield f

    def partitions(self) -> list[File]:
        return [f for f in files_of(self.paths) if self.named is None or f.path in self.named]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.schema, self.wanted)


class StreamReader(DataSourceStreamReader):
    """New files of folders, as they come: those with names after the last one that was read, so names must grow, as numbered ones do."""

    def __init__(self, paths: list[str], schema: StructType):
        self.paths, self.schema = paths, to_arrow_schema(schema)

    def _files(self) -> list[File]:
        try:
            return sorted(files_of(self.paths), key=lambda f: (f.path, f.given))
        except ValueError:
            return []

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max((f.path for f in self._files()), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [f for f in self._files() if start["after"] < f.path <= end["after"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return batches(partition, self.schema, None)


class ArticleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "articles"

    def schema(self) -> str:
        return SCHEMA

    def _paths(self) -> list[str]:
        if "paths" in self.options:
            return json.loads(self.options["paths"])
        return [self.options["path"]]

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._paths(), schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self._paths(), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArticleSource)
