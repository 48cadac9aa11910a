"""Incremental message ingest and windowed mention counts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.text import is_admin, message_tokens
from ..settings import MENTION_STOPWORDS
from ..sources.tables import append_messages


def ingest_messages(stream: DataFrame, path: str, checkpoint: str):
    """Append each (group, message) once, whenever it is delivered; blank messages are dropped.

    Ids grow within a group, so each micro-batch keeps what is above the stored marks of
    earlier batches, one row per group and batch.  No message is late, and a batch that runs
    again after a failure replaces its own files.
    """
    run = zlib.crc32(checkpoint.encode())  # batch numbers belong to a checkpoint

    def write(batch: DataFrame, number: int) -> None:
        append_messages(batch.sparkSession, batch, path, f"{run}-{number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def mention_windows(stream: DataFrame, symbols: DataFrame, *, window: str = "7 days", slide: str | None = None,
                    delay: str | None = None) -> DataFrame:
    """Mentions and broadcast mentions per symbol and event-time window.

    Tokens join the symbol list as a stream-static join; counting has map-side combine.
    With a ``delay``, windows that ended longer ago leave the state and later messages for
    them are not counted; without one every message counts.
    """
    timed = stream.withWatermark("ts", delay) if delay else stream
    tokens = timed.select(
        "ts", is_admin(F.col("sender")).alias("admin"),
        F.explode(F.array_distinct(message_tokens(F.col("text"), "[A-Z&]{3,}", MENTION_STOPWORDS))).alias("symbol"))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return tokens.join(symbols.select("symbol").distinct(), "symbol", "left_semi").groupBy(span.alias("w"), "symbol").agg(
        F.count(F.lit(1)).alias("mentions"), F.count_if("admin").alias("admin_mentions"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "symbol", "mentions", "admin_mentions")


def run_updates(df: DataFrame, path: str, checkpoint: str):
    """Run what is available; every changed row of an aggregation is stored under its batch.

    Windows still open are stored too.  ``latest_rows_of`` reads the newest row of each key.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_rows_of(spark, path: str, keys: tuple[str, ...]) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    others = [c for c in rows.columns if c not in (*keys, "batch_no")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_no").alias("r")).select(*keys, "r.*")


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what is available into a parquet table and return the finished query."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
