"""Structured Streaming over events; each function takes a batch or a stream, so every result has a batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, some files a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def bounds() -> list:
    """A window's ends, as times without a zone, which events have."""
    return [F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end")]


def timed(events: DataFrame) -> DataFrame:
    """Event time with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return _window(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return _window(events, F.window("ts", width, step), late)


def _window(events: DataFrame, window, late: str) -> DataFrame:
    grouped = timed(events).withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*bounds(), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    grouped = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(*bounds(), "user_id", "n", "total")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    if events.isStreaming:
        return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) so far, kept as state by user."""
    if not events.isStreaming:
        return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def update(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, through the stream, as a table in memory."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return spark.table(name)
