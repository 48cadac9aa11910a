"""Which files there are, which of them count, and what their first lines say, before any of them is read.

A manifest is a DataFrame with one row per file: ``path``, ``unit`` (the file, or the folder that Spark wrote under a
file's name), ``priority`` (place of its directory among those given), ``modified`` and ``bytes``. It comes from
Spark's own listing; no file is opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that are read at a time until its first line ends.
FIRST_BYTES = 8192
#: A manifest of up to so many files is sent to all tasks; a row has some 200 bytes.
BROADCAST_FILES = 100_000


def unit_of(path: Column) -> Column:
    """The file itself, or the folder above it where that has a file's name or a date at its end."""
    folder = F.regexp_extract(path, r"^(.*(?:\.csv|_\d{8}|_\d{4}-\d{2}-\d{2}))/[^/]*$", 1)
    return F.coalesce(F.nullif(folder, F.lit("")), path)


def list_files(spark: SparkSession, directories: str | Sequence[str]) -> DataFrame:
    """The manifest of all files under some directories, the first of which has priority 0."""
    given = [directories] if isinstance(directories, str) else list(directories)
    parts = [
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d).select(
            "path", unit_of(F.col("path")).alias("unit"), F.lit(i).alias("priority"),
            F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
        for i, d in enumerate(given)
    ]
    return reduce(DataFrame.union, parts)


def one_per_date(manifest: DataFrame, date: Column, form: Column) -> DataFrame:
    """(date, unit, priority): for each date the unit of the first directory, then of the best name form, then by name.

    ``date`` and ``form`` are read off ``unit``; units without a date are left out. The result has one row per
    calendar date, however many files a date has.
    """
    named = manifest.select("unit", "priority").withColumns({"date": date, "_form": form}).where(F.col("date").isNotNull())
    best = named.groupBy("date").agg(F.min(F.struct("priority", "_form", "unit")).alias("b"))
    return best.select("date", "b.unit", "b.priority")


def _opens_here(path: str) -> bool:
    """Whether Arrow can open such paths by itself."""
    return path.startswith(("file:", "/", "s3:", "s3a:", "gs:", "hdfs:"))


def _arrow_file(path: str) -> pa.NativeFile:
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem().open_input_stream("/" + uri.removeprefix("file:").lstrip("/"))
    system, name = pafs.FileSystem.from_uri(uri)
    return system.open_input_stream(name)


def _first_line(path: str) -> str:
    with _arrow_file(path) as stream:
        head = b""
        while b"\n" not in head:
            more = stream.read(FIRST_BYTES)
            if not more:
                break
            head += more
    return head.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace")


def first_lines(manifest: DataFrame) -> DataFrame:
    """(path, header): the first line of every file, read on the executors a few kilobytes at a time.

    Files of a store that only Spark can open are read through Spark's text reader, which goes through whole files.
    """
    spark = manifest.sparkSession
    paths = manifest.select("path")
    some = paths.first()
    if some is None or _opens_here(some.path):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = batch.column(0).to_pylist()
                yield pa.record_batch([pa.array(given, pa.string()), pa.array([_first_line(p) for p in given], pa.string())], ["path", "header"])

        # one task per few hundred files at most, so that many small reads go on at once
        spread = max(1, min(spark.sparkContext.defaultParallelism * 4, 1000))
        return paths.repartition(spread).mapInArrow(run, "path string, header string")
    units = [r.unit for r in manifest.select("unit").distinct().collect()]
    lines = spark.read.text(units, recursiveFileLookup=True).select(
        "value", plain_path().alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    return lines.groupBy("path").agg(F.min_by("value", "at").alias("header"))


def plain_path() -> Column:
    """Path of the file a row came from, with URL escapes (spaces) undone, as the manifest has it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
