"""The recall log as a stream: deliveries once, late rows by watermark, running counts and sessions.

An extension: the engine itself is batch. Activation stays a batch read, since every score changes
whenever ``now`` moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.operators.activation import instant
from larkspur.sources.store import SCHEMAS


def recall_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of recall events as they appear in a folder."""
    r = spark.readStream.schema(SCHEMAS["recall_events"])
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events with a readable time (``at``), each id once within the watermark."""
    timed = events.withColumn("at", instant(F.col("ts"))).where("at is not null").withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["id"])


def recalls_per_hour(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``hour, query_scope, n``: closed hours of recalls per scope."""
    w = F.window("at", "1 hour")
    return once(events, late).groupBy(w, "query_scope").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "query_scope", "n")


def streamed_sessions(events: DataFrame, late: str = "2 hours", gap: str = "30 minutes") -> DataFrame:
    """``queried_by, query_scope, start_ms, end_ms, n_events``: sessions closed by the watermark."""
    keyed = once(events, late).where("queried_by is not null and query_scope is not null")
    s = keyed.groupBy(F.session_window("at", gap), "queried_by", "query_scope").agg(F.count("*").alias("n_events"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return s.select("queried_by", "query_scope", F.unix_millis("lo").alias("start_ms"), F.unix_millis("hi").alias("end_ms"), "n_events")


def append_to(events: DataFrame, folder: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Appends each event once to a Parquet table; runs until the present input is used up."""
    return once(events, late).drop("at").writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
