"""Shared pieces of the training-data operators: storage between jobs, text rules, gapless numbering."""

from __future__ import annotations

import atexit
import shutil
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`.
WORD_SPACE = " \t\n\x0b\x0c\r"

_fallback_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session of one JVM has none, as in tests, a temporary folder of this process; a cluster must name one.
    """
    global _fallback_dir
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _fallback_dir is None:
        _fallback_dir = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, _fallback_dir, ignore_errors=True)
    return _fallback_dir


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage so that lost executors cost a re-read, and fixes values that a second
    evaluation could give differently. The files go when the JVM ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/citeloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is several times faster than ``translate`` and does the same where no other
    character has a lower case, so it serves those texts.
    """
    other_upper = r"[\p{IsUppercase}\p{IsTitlecase}&&[^\x00-\x7F]]"
    return F.when(text.rlike(other_upper), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def salt_count(rows: int, per_salt: int = 100_000) -> int:
    """Parts into which to deal a key's rows so that none outgrows ``per_salt`` by much."""
    return max(64, -(-rows // per_salt))


def number_within(df: DataFrame, keys: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each combination of ``keys``.

    Rows of a key are dealt to salts by a hash of ``order``; each (key, salt) is numbered by
    its own window, and the salts' counts, summed up, give the place where each begins. A key
    with a third of all rows is therefore never in one task. ``order`` must be a total order for
    the numbers to be the same in each run; ``df`` should be stored, since it is read twice.
    """
    salts = salt_count(rows)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = stash(salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")), "counts")
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_i", F.row_number().over(inside) - 1)
    cond = numbered["_salt"] == starts["_salt"]
    for k in keys:
        cond = cond & numbered[k].eqNullSafe(starts[k])
    return numbered.join(starts, cond).select(*[numbered[c] for c in df.columns], (F.col("_i") + F.col("_start")).cast("long").alias(out))
