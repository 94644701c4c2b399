"""Edge events as a stream: appended to a store's log, with windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans.store import GraphStore

EVENT_SCHEMA = "event_id long, ts timestamp, src long, dst long, op string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of edge events; the files per trigger set the rate."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def rated_edges(spark: SparkSession, edges: DataFrame, rate: int) -> DataFrame:
    """Replay (seq, src, dst) at about ``rate`` edges a second; ``seq`` from 0 without gaps."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return clock.join(edges, clock["value"] == edges["seq"]).select(F.col("seq").alias("event_id"), F.col("timestamp").alias("ts"), "src", "dst", F.lit("INSERT").alias("op"))


def ingest(events: DataFrame, store: GraphStore, checkpoint: str, compact_every: int = 0):
    """Start a query that appends each micro-batch as one commit, and compacts every few batches."""

    def commit(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        store.append(batch.select("op", "src", "dst", F.col("event_id").alias("n")))
        if compact_every and (number + 1) % compact_every == 0:
            store.compact()

    return events.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, src, writes): updates of each vertex by tumbling window; later events than ``late`` are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "src").agg(F.count(F.lit(1)).alias("writes"))
    return counted.select(F.col("window.start").alias("window_start"), "src", "writes")
