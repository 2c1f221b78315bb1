"""Incremental work over folders that grow.

New graph documents are read as a stream; each micro-batch is cleaned of stems
that are already there and handed to a function with the tables of the batch.
Event streams get windowed counts with watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.graphs import DOCUMENT, GraphTables, tables


def document_stream(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of graph documents with their stems."""
    raw = spark.readStream.schema(DOCUMENT.replace("stem string, ", "")).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)
    return raw.withColumn("stem", F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1)))


def on_new_graphs(stream: DataFrame, done: Callable[[SparkSession], DataFrame | None], handle: Callable[[GraphTables, int], None], checkpoint: str) -> StreamingQuery:
    """Calls handle(tables, batch number) for the documents of each batch whose stem is not in done(spark) (stem).

    A batch that is run again after a failure sees what handle() had stored,
    so stems are handled once if handle() stores them at the end.
    """

    def each(batch: DataFrame, number: int) -> None:
        known = done(batch.sparkSession)
        new = batch if known is None else batch.join(known.select("stem"), "stem", "left_anti")
        handle(tables(new.dropDuplicates(["stem"])), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a time that watermarks accept; streams get one."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if x.isStreaming else x


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean): tumbling or sliding windows of a stream or table of events (ts, event_type, value)."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    source = _timed(events, late)
    g = source.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of users that end after a gap."""
    source = _timed(events, late)
    g = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
