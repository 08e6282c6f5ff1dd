"""Keyed tables of a base and deltas: writes in proportion to what is written, merged when read."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import DOCUMENT

_GONE, _COMMIT = "_gone", "_commit"


class KeyedStore:
    """Rows by a key, in ``buckets`` buckets by its hash.

    Each write is a folder of its own, by bucket, that a numbered file in ``_log`` puts into the table: the log's newest file names the folders that
    make it up. So readers see one snapshot, a writer that dies leaves nothing that counts, and of two that write at once the
    second takes the next number. Of rows of a key the last written counts, or, in a table with a ``seq``, that of the largest seq. Removed keys are rows that say so. After
    ``most_deltas`` writes those buckets that they touched are written anew as base; others stay. A folder of plain Parquet files is taken as the first base.
    """

    key = "key"

    def __init__(self, spark: SparkSession, path: str, *, key: str | None = None, buckets: int = 32, most_deltas: int = 8, schema: object = None):
        self.spark, self.path, self.buckets, self.most_deltas, self.schema = spark, path.rstrip("/"), buckets, most_deltas, schema
        self.key = key or self.key
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log.

    def _versions(self) -> list[int]:
        log = self._place(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        return sorted(int(n[:-5]) for f in self._fs.listStatus(log) if (n := str(f.getPath().getName())).endswith(".json"))

    def snapshot(self, version: int | None = None) -> dict:
        """The newest entry of the log, or that of ``version``; an empty one where nothing was written yet. Entries that were cut off are passed over."""
        for n in reversed(self._versions()):
            if version is None or n == version:
                try:
                    return json.loads(self.spark.read.text(f"{self.path}/_log/{n:020d}.json", wholetext=True).first()["value"])
                except (ValueError, TypeError):
                    continue
        return {"version": 0, "buckets": self.buckets, "parts": [], "done": {}}

    def _commit(self, change) -> dict:
        """Write the entry that ``change`` makes of the newest one; again, if another writer took its number."""
        while True:
            entry = change(self.snapshot())
            entry["version"] = max([0, *self._versions()]) + 1
            try:
                out = self._fs.create(self._place(f"{self.path}/_log/{entry['version']:020d}.json"), False)
            except Py4JJavaError as e:
                if "exist" in str(e.java_exception).lower():
                    continue
                raise
            try:
                out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
            finally:
                out.close()
            return entry

    def _write(self, rows: DataFrame, buckets: int) -> dict:
        """A folder of ``rows`` by bucket, which nothing names yet."""
        folder = f"commit={uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(F.col(self.key), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(self._place(f"{self.path}/{folder}"))]
        return {"folder": folder, "buckets": sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket=")), "schema": rows.schema.json()}

    @staticmethod
    def _bucket(key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    # Reading.

    def _read(self, part: dict, number: int) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(part["schema"])).add("bucket", T.IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part['folder']}").filter(F.col("bucket").isin(part["buckets"])).withColumn(_COMMIT, F.lit(number))

    def _merged(self, entry: dict, only: list[int] | None = None) -> DataFrame | None:
        """Rows with bucket and mark, of the buckets ``only``, with removed ones; keys that no delta has go past the merge."""
        wanted = lambda p: [b for b in p["buckets"] if only is None or b in only]
        parts = [(n, p | {"buckets": wanted(p)}) for n, p in enumerate(entry["parts"]) if wanted(p)]
        if not parts:
            return None
        both = lambda a, b: a.unionByName(b, allowMissingColumns=True)
        base = [self._read(p, n) for n, p in parts if p["kind"] == "base"]
        deltas = [self._read(p, n) for n, p in parts if p["kind"] == "delta"]
        if not deltas:
            return reduce(both, base)
        delta = reduce(both, deltas)
        keys = delta.select(self.key).distinct()
        met = reduce(both, [b.join(keys, self.key, "left_semi") for b in base] + [delta])
        order = F.struct(F.coalesce("seq", F.lit(0)), _COMMIT) if "seq" in met.columns else F.struct(_COMMIT)
        last = met.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in met.columns if c != self.key]), order).alias("_r")).select(self.key, "_r.*")
        return reduce(both, [b.join(keys, self.key, "left_anti") for b in base] + [last]).select(*met.columns)

    def _plain(self) -> DataFrame | None:
        """Parquet files that lie in the folder itself, from before it had a log."""
        try:
            return self.spark.read.parquet(f"{self.path}/*.parquet")
        except AnalysisException:
            return None

    def table(self, version: int | None = None) -> DataFrame:
        """All rows of the newest snapshot, or of that ``version``; an empty table where nothing was written yet."""
        entry = self.snapshot(version)
        rows = self._merged(entry) if entry["version"] else self._plain()
        if rows is None:
            return self.spark.createDataFrame([], self.schema or f"{self.key} string")
        return rows.filter(~F.col(_GONE)).drop(_GONE, _COMMIT, "bucket") if entry["version"] else rows

    def get(self, keys: list[str]) -> DataFrame:
        """Those of the given keys that there are; buckets without them aren't read, and the keys are pushed down to the scan."""
        entry = self.snapshot()
        if not entry["version"] or not keys:
            return self.table().filter(F.col(self.key).isin(keys))
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self._bucket(F.col("k"), entry["buckets"]).alias("b"))
        rows = self._merged(entry, sorted({r["b"] for r in asked.collect()}))  # as many as were asked for
        return self.table().limit(0) if rows is None else rows.filter(F.col(self.key).isin(keys) & ~F.col(_GONE)).drop(_GONE, _COMMIT, "bucket")

    def contains(self, key: str) -> bool:
        return not self.get([key]).isEmpty()

    def count(self) -> int:
        return self.table().count()

    def scan(self) -> DataFrame:
        """All rows in the order of their keys."""
        return self.table().orderBy(self.key)

    # Writing.

    def upsert(self, rows: DataFrame, *, done: tuple[str, int] | None = None) -> bool:
        """Write ``rows``, of which the largest ``seq``, if there is one, counts where keys repeat. ``done`` names a writer and the number of what it writes:
        one that was written before is not written again, and False returned. Null keys are left out."""
        first = self.snapshot()
        if done and first["done"].get(done[0], -1) >= done[1]:
            return False
        cols = [c for c in rows.columns if c != self.key]
        order = F.col("seq") if "seq" in cols else F.xxhash64(*cols) if cols else F.lit(0)
        one = rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(self.key, "_r.*")
        return self._add(one.select(*rows.columns).withColumn(_GONE, F.lit(False)), done)

    def remove(self, keys: DataFrame) -> None:
        """Remove the rows whose keys a table has; it may have others."""
        gone = self.table().join(keys.select(self.key).distinct(), self.key, "left_semi")
        self._add(gone.withColumn(_GONE, F.lit(True)), None)

    def _add(self, rows: DataFrame, done: tuple[str, int] | None) -> bool:
        buckets = self.snapshot()["buckets"]
        old = [] if self._versions() else [self._plain()]
        base = [self._write(o.withColumn(_GONE, F.lit(False)), buckets) | {"kind": "base"} for o in old if o is not None]
        part = self._write(rows, buckets) | {"kind": "delta"}

        def change(entry: dict) -> dict:
            if done and entry["done"].get(done[0], -1) >= done[1]:
                return entry
            held = entry["parts"] or base
            kind = "delta" if held else "base"
            return entry | {"parts": [*held, part | {"kind": kind}], "done": entry["done"] | ({done[0]: done[1]} if done else {})}

        entry = self._commit(change)
        if sum(p["kind"] == "delta" for p in entry["parts"]) >= self.most_deltas:
            self.compact()
        return True

    def compact(self) -> None:
        """Write the buckets that deltas touch anew, without removed rows; a write in between stays a delta."""
        entry = self.snapshot()
        seen = {p["folder"] for p in entry["parts"]}
        touched = sorted({b for p in entry["parts"] if p["kind"] == "delta" for b in p["buckets"]})
        if not touched:
            return
        rows = self._merged(entry, touched).filter(~F.col(_GONE)).drop(_COMMIT, "bucket")
        fresh = self._write(rows, entry["buckets"]) | {"kind": "base"}

        def change(now: dict) -> dict:
            if not seen <= {p["folder"] for p in now["parts"]}:
                return now  # compacted by another writer
            kept = [p | {"buckets": [b for b in p["buckets"] if b not in touched]} for p in now["parts"] if p["folder"] in seen and p["kind"] == "base"]
            later = [p for p in now["parts"] if p["folder"] not in seen]
            return now | {"parts": [*[p for p in kept if p["buckets"]], fresh, *later]}

        self._commit(change)

    def vacuum(self) -> int:
        """Delete the folders that the newest snapshot doesn't name, also those of dead writers; how many. No older snapshot can be read then, so nobody should be reading or writing."""
        live = {p["folder"] for p in self.snapshot()["parts"]}
        dead = [f.getPath() for f in self._fs.listStatus(self._place(self.path)) if str(f.getPath().getName()).startswith("commit=") and str(f.getPath().getName()) not in live]
        for p in dead:
            self._fs.delete(p, True)
        return len(dead)


class DocumentStore(KeyedStore):
    """Documents by pmid."""

    key = "pmid"

    def __init__(self, spark: SparkSession, path: str, **options):
        super().__init__(spark, path, **({"schema": DOCUMENT} | options))

    def add(self, docs: DataFrame) -> int:
        """Upsert ``docs``, which may have a seq that says which of repeated ids counts (the largest); how many documents there are then."""
        cols = [c for c in docs.columns if c != "seq"]
        if "seq" in docs.columns:
            docs = docs.groupBy("pmid").agg(F.max_by(F.struct(*[c for c in cols if c != "pmid"]), "seq").alias("_r")).select("pmid", "_r.*").select(*cols)
        self.upsert(docs)
        return self.count()
