"""Table sinks and incremental reads: idempotent date replace, nested JSON, message log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.screeners import normalize_screener, weight_map
from ..settings import SCREENER_WEIGHTS

def replace_dates(df: DataFrame, path: str) -> None:
    """Write ``df`` so that exactly its dates are replaced in the table at ``path``.

    The rebalance hint lets Spark split a large date over several tasks.
    """
    (df.hint("rebalance", "date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """Report sink; arrays become comma text because CSV has no nested types."""
    flat = [F.array_join(F.col(c).cast("array<string>"), ", ").alias(c) if t.startswith("array<") else F.col(c)
            for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row; missing values are written as null."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def clean_weights(raw: DataFrame, order: str) -> DataFrame:
    """(screener, weight) with normalized names; of duplicates the last in ``order`` wins."""
    rows = raw.select(normalize_screener(F.col("screener")).alias("screener"),
                      F.col("weight").try_cast("int").alias("weight"), F.col(order).alias("_o"))
    return rows.groupBy("screener").agg(F.max_by("weight", "_o").alias("weight"))


def builtin_weights() -> Column:
    """The built-in weights as a map column; a table of weights is joined by ``add_pattern_points``."""
    return weight_map(SCREENER_WEIGHTS)


def add_pattern_points(sheet: DataFrame, weights: DataFrame, cap: int = 30, unseen: int = 3) -> DataFrame:
    """Pattern points by joining the exploded screener names to a weight table of any size."""
    names = sheet.select("symbol", "date", F.explode("screeners").alias("_s")).select(
        "symbol", "date", normalize_screener(F.col("_s")).alias("screener")).distinct()
    points = names.join(weights, "screener", "left").groupBy("symbol", "date").agg(
        F.least(F.sum(F.coalesce("weight", F.lit(unseen))), F.lit(cap)).cast("int").alias("pattern_points"))
    return sheet.join(points, ["symbol", "date"], "left").fillna(0, ["pattern_points"])


def stored_marks(spark: SparkSession, path: str, without: str = "") -> DataFrame:
    """(group_id, last_id) from the marks kept beside the log at ``path``, but for those of the batch ``without``."""
    spark.range(0).select(F.lit("").alias("group_id"), F.lit(0).cast("long").alias("last_id")).withColumn(
        "batch", F.lit("")).write.mode("overwrite").parquet(f"{path}_marks/none")
    marks = spark.read.schema("group_id string, last_id long, batch string").option("recursiveFileLookup", True).parquet(f"{path}_marks")
    return marks.where(F.col("batch") != without).groupBy("group_id").agg(F.max("last_id").alias("last_id"))


def append_messages(spark: SparkSession, incoming: DataFrame, path: str, batch: str | None = None) -> int:
    """Append the new messages to the log at ``path``; returns how many were added.

    Only the marks, one row per group and batch, are read, never the log.  A named ``batch`` that is delivered again
    replaces what its first delivery wrote.
    """
    name = batch or uuid.uuid4().hex
    marks = stored_marks(spark, path, name)
    rows = (incoming.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
            .dropDuplicates(["group_id", "message_id"])
            .join(marks, "group_id", "left").where(F.col("last_id").isNull() | (F.col("message_id") > F.col("last_id"))).drop("last_id"))
    own = f"{path}/batch={name}"
    rows.write.mode("overwrite").parquet(own)
    added = spark.read.schema(rows.schema).parquet(own)
    added.groupBy("group_id").agg(F.max("message_id").cast("long").alias("last_id")).withColumn(
        "batch", F.lit(name)).write.mode("overwrite").parquet(f"{path}_marks/{name}")
    return added.count()
