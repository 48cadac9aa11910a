"""Readers of the remaining vendor files: chat messages, listed companies, sectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.screeners import strip_ws

# Columns of the message files, in order; their header names only the first four.
MESSAGE_COLUMNS = ("message_id", "date_ist", "sender", "text", "group_id")
# Columns of the listing and of the sector file.
LISTING_SYMBOL, LISTING_NAME = "SYMBOL", "NAME OF COMPANY"
SECTOR_SYMBOL, SECTOR_NAME = "Symbol", "Sector"


def read_messages(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(message_id, date, sender, text, group_id) by column place, whatever the header says.

    Texts may hold line breaks, so a file is one task; the log grows by files, not by one file.
    Rows without a fifth cell have no group, rows whose id is not a number are left out.
    """
    schema = ", ".join(f"{c} string" for c in MESSAGE_COLUMNS)
    raw = spark.read.csv(paths, schema=schema, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        F.expr("try_cast(trim(message_id) as bigint)").alias("message_id"),
        F.expr("try_cast(substring(trim(date_ist), 1, 10) as date)").alias("date"),
        F.trim("sender").alias("sender"), "text", F.trim("group_id").alias("group_id"),
    ).where(F.col("message_id").isNotNull())


def read_listing(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(symbol, company_name, place) of listed companies; ``place`` orders rows as the files have them.

    It is (path, start of the split, row in the split), so a listing of many files or splits keeps
    its order without one task that numbers it.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"))
    raw = spark.read.csv(paths, header=True, quote='"', escape='"')
    named = {c.strip(): c for c in raw.columns}
    return raw.select(
        strip_ws(F.col(f"`{named[LISTING_SYMBOL]}`")).alias("symbol"),
        F.col(f"`{named[LISTING_NAME]}`").alias("company_name"), place.alias("place"))


def read_sectors(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(symbol, sector), one row per symbol: the last one that names a sector in path order."""
    raw = spark.read.csv(paths, header=True, quote='"', escape='"')
    named = {c.strip(): c for c in raw.columns}
    at = F.struct(
        F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("s"),
        F.monotonically_increasing_id().alias("i"))
    rows = raw.select(
        strip_ws(F.col(f"`{named[SECTOR_SYMBOL]}`")).alias("symbol"),
        F.nullif(strip_ws(F.col(f"`{named[SECTOR_NAME]}`")), F.lit("")).alias("sector"), at.alias("at"))
    rows = rows.where(F.col("symbol").isNotNull() & F.col("sector").isNotNull())
    return rows.groupBy("symbol").agg(F.max_by("sector", "at").alias("sector"))
