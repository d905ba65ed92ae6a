"""Incremental ingestion: new files as a stream, merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def stream_of(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def merge_into(store: Store, scans: DataFrame, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Puts each micro-batch of scanned files into the store; a batch that is run again changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_files(batch.dropDuplicates(["uri"]))

    writer = scans.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, *, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events and their values by window and type; the same plan for a table and a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
