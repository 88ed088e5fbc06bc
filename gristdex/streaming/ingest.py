"""Structured Streaming: postings appended as they arrive, and counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POSTINGS = "table_seq INT, keyword STRING, doc BIGINT, seq INT, score FLOAT, pct5 FLOAT, pct25 FLOAT, pct75 FLOAT, pct95 FLOAT, loaded_at TIMESTAMP"


def posting_stream(spark: SparkSession, path: str, schema: str = POSTINGS, files_per_trigger: int = 64) -> DataFrame:
    """Posting files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_arrivals(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Drops rows loaded again within ``lateness``: same table, keyword, document, number and score."""
    return stream.withWatermark("loaded_at", lateness).dropDuplicatesWithinWatermark(["table_seq", "keyword", "doc", "seq", "score"])


def append_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends a stream to a Parquet table, each file once whatever fails."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrivals(stream: DataFrame, window: str = "1 day", slide: str | None = None, lateness: str = "2 days", time: str = "loaded_at", key: str = "keyword") -> DataFrame:
    """(from, to, key, n) by tumbling or sliding windows; rows later than ``lateness`` are dropped, null keys and times left out."""
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, lateness)
    span = F.window(time, window, slide) if slide else F.window(time, window)
    counted = rows.groupBy(span.alias("span"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("span.start").alias("from"), F.col("span.end").alias("to"), "key", "n")
