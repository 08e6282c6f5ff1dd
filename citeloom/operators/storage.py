"""Cutting lineage in the shared folder, and indexes that a session builds once."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

_fallback: list[str] = []
_built: dict[tuple, tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; in one JVM without it, as in tests, a temporary folder."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="citeloom-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return _fallback[0]


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, which goes when the JVM ends."""
    where = f"{shared_dir(spark)}/citeloom/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)  # only of what there is
    return where


def settled(df: DataFrame, *, by: str | None = None) -> DataFrame:
    """``df`` computed and kept as Parquet in the shared folder until the JVM ends; in folders of ``by``, so that a filter on it reads its own alone."""
    spark = df.sparkSession
    where = scratch(spark, "settled")
    (df.write.partitionBy(by) if by else df.write).mode("append").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def _files_of(source: DataFrame) -> tuple:
    """Path, time and length of each file of ``source``; the file system is asked once for each folder."""
    spark = source.sparkSession
    conf, fs_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    names = {str(fs_path(n)) for n in source.inputFiles()}
    files = []
    for folder in sorted({n.rsplit("/", 1)[0] for n in names}):
        p = fs_path(folder)
        files += [(n, f.getModificationTime(), f.getLen()) for f in p.getFileSystem(conf).listStatus(p) if (n := str(f.getPath())) in names]
    return tuple(sorted(files))


def fingerprint(source: DataFrame) -> str:
    """A name of the rows of ``source``: by its files, or, where it reads none, by its rows. Rows that are made of files and others should be stored first."""
    files = _files_of(source)
    if not files:
        h = F.xxhash64(*source.columns)
        files = tuple(source.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
    return hashlib.sha256(repr(files).encode()).hexdigest()


def _once(source: DataFrame, kind: str, build: Callable[[str], T]) -> tuple[str, T]:
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, kind, _files_of(source))
    if key not in _built:
        where = scratch(spark, kind)
        _built[key] = where, build(where)
    return _built[key]


def built_once(source: DataFrame, kind: str, build: Callable[[str], T]) -> T:
    """What ``build(path)`` makes of ``source``, once in a Spark application for the same files; they are told by path, time and length.

    ``path`` is a new folder in the shared one, which goes when the JVM ends.
    """
    return _once(source, kind, build)[1]


def built(source: DataFrame, kind: str) -> object | None:
    """What ``built_once`` has made of ``source`` in this Spark application, None where it hasn't."""
    key = (source.sparkSession.sparkContext.applicationId, kind, _files_of(source))
    return _built[key][1] if key in _built else None


def replace(rows: DataFrame, path: str) -> None:
    """Write ``rows`` beside ``path`` and put them in its place when they are whole; a failed job leaves what was there."""
    spark = rows.sparkSession
    conf, fs_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    place, new, old = fs_path(path), fs_path(f"{path}.new-{mark}"), fs_path(f"{path}.old-{mark}")
    rows.write.parquet(str(new))
    fs = place.getFileSystem(conf)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, place):
        raise OSError(f"{new} can't be moved to {path}")
    fs.delete(old, True)
