"""Streaming ingest and windowed telemetry. The batch engine has no such thing to be compared with; these are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.sources.store import DocumentStore


def stream_upserts(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Upsert each micro-batch of documents (pmid, ..., seq) into a store of base and deltas; of a document's rows that of the largest seq counts.

    A batch writes its own rows alone. One that runs again, as after a lost driver, is known by its number and not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        DocumentStore(batch.sparkSession, store).upsert(batch, done=(checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str, version: int | None = None) -> DataFrame | None:
    """The newest snapshot of the store, or that of ``version``; None if there is none yet."""
    found = DocumentStore(spark, store)
    return found.table(version) if found.snapshot()["version"] else None


def windowed_latency(events: DataFrame, *, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, mean) of events (ts, event_type, value) by tumbling windows; later events than ``late`` are left out."""
    w = F.window("ts", width)
    seen = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return seen.select(F.col("w.start").alias("start"), "event_type", "n", "mean")
