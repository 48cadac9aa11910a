"""Column helpers of the operators that stay in DataFrame functions, and row identity for the ones that come back to a row."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of other characters.
SPACES = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, SPACES), lambda w: w != "")


def id_checksum(name: str) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def id_remainder(name: str, modulus: int) -> Column:
    return id_checksum(name) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def row_key(id_name: str = "doc_id", text_name: str = "text") -> Column:
    """Identity of a row by content: rows with the same id and text are copies and share every result.

    A null id sorts after all ids.
    """
    return F.struct(
        F.coalesce(F.col(id_name), F.lit(2**63 - 1)).cast("long").alias("id"),
        F.xxhash64(text_or_empty(text_name)).alias("hash"),
    )
