"""Ingestion jobs as a stream: files land, states advance, failures are classed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States in order; a state never goes back.
STATES = ("queued", "running", "completed", "failed")
FAILURES = (
    ("connection", r"(?i)timed? ?out|connection|unavailable"),
    ("authentication", r"(?i)api key|unauthori[sz]ed|forbidden"),
    ("parsing", r"(?i)parse|corrupt|unsupported|empty"),
)
EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())]
    + [T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def failure_class(message: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(FAILURES):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def job_events(spark: SparkSession, folder: str, files_at_once: int = 128) -> DataFrame:
    """A stream over files that land in ``folder``; the bound on files at once is the queue's."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def state_rank(event_type: Column) -> Column:
    """The place of an event's state in STATES."""
    return F.when(event_type == "error", 3).when(event_type == "purchase", 2).when(event_type == "click", 0).otherwise(1)


def latest_states(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The furthest state of each document so far and how many events it had; update mode. Works for a batch as well.

    A late event of an earlier state adds to the count only. A document's state may change at any time, so it is kept for good: the
    store grows with the documents, a few bytes each, not with the events.
    """
    rank = state_rank(F.col("event_type"))
    made = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).groupBy("user_id").agg(F.max(rank).alias("state"), F.count("*").alias("events"))
    return made.select(F.col("user_id").alias("document_id"), F.element_at(F.array(*map(F.lit, STATES)), F.col("state") + 1).alias("status"), "events")


class QueueFull(RuntimeError):
    """More jobs wait than the queue holds."""


def enqueue(new: DataFrame, waiting: DataFrame, bound: int = 128) -> DataFrame:
    """Rows of (document_id, status) for documents that are handed in while ``waiting`` jobs are queued; an error where both are more
    than ``bound``. Only the bound and one row are ever counted."""
    if waiting.where("status = 'queued'").select("document_id").unionByName(new.select("document_id")).limit(bound + 1).count() > bound:
        raise QueueFull(f"more than {bound} jobs would wait")
    return new.select("document_id", F.lit("queued").alias("status"))


def retryable(documents: DataFrame, raw_files: DataFrame) -> DataFrame:
    """Documents whose ingestion may be tried again: failed, indexed or completed ones whose raw file is still there."""
    return documents.where(F.col("status").isin("failed", "indexed", "completed")).join(raw_files.select("document_id").distinct(), "document_id", "left_semi")


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events by hour and kind; append mode gives an hour once it is past the watermark."""
    made = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay).groupBy(F.window("at", "1 hour").alias("w"), "event_type")
    return made.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that has landed, a batch at a time; a batch is handled again only after a failure."""
    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
