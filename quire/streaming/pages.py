"""Pages that arrive over time: the batch conversion inside Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.plans import convert as C

GATE = [x.split()[0] for x in C.GATE.split(", ")]


def page_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Tables of pages (page_id, url, html) as they are added to a folder."""
    schema = "page_id bigint, url string, html string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def convert_stream(pages: DataFrame, output: str, checkpoint: str, available_now: bool = True):
    """Convert each micro-batch and append it to a table; returns the query.

    A batch writes below its own number, so one that is run again after a failure replaces what it wrote before.
    """

    def batch(df: DataFrame, number: int) -> None:
        C.convert_pages(df).select("page_id", "markdown", *GATE).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def arrivals(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, kind, n): events counted in windows, those later than ``late`` dropped; for streams and for tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
