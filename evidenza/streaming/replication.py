"""Followers as streams: a log folder read in order, state kept by the same aggregates as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import changelog

LOG = "offset long, line string"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Copy a log to a follower's folder, all of a micro-batch or nothing.

    The batch number names the folder that a batch goes to, so a batch that is run again after a failure
    replaces itself. Records that do not decode stop the stream before they are written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        changelog.decode(batch).write.format("noop").mode("overwrite").save()
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return log_stream(spark, source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follower_log(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(LOG + ", batch int").parquet(target).select("offset", "line")


def ack_counts(acks: DataFrame) -> DataFrame:
    """Streaming: distinct replicas per commit; each replica counts once, however often it reports."""
    return acks.dropDuplicates(["commit_id", "replica_id"]).groupBy("commit_id").agg(F.count("*").alias("acks"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events per type in tumbling windows, late ones dropped behind a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Extension: sessions of users that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
