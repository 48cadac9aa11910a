"""Token counts with a digest cache: only content that no earlier run has counted is encoded.

The cache is a Parquet table of (content digest, tokenizer digest, count). Documents are reduced to digests; the
distinct digests that the cache does not hold are the misses; one document of each miss is read again and encoded;
the new counts are appended, and every document takes its count from the cache by its digest.

A miss is represented by (digest, smallest id), chosen by an aggregate with map-side combine, so a text that a third of
all rows hold is one row after the first stage. Where the misses are too many to broadcast, texts are shuffled once to
meet them, keyed by digest and their own id, so copies with ids of their own are spread. Joins on digests are plain
equi-joins of narrow rows, where adaptive execution splits a hot digest. A lost executor repeats its tasks; a count
appended twice by two runs does no harm, because the cache is read with one count per digest.

Defined cases: null text counts as empty (0 tokens, 0 bytes). Content is normalised only by that, since the tokenizer
sees every other difference. Repeated rows each get their count. Special strings inside texts count as the
tokenizer's default has them. Characters that are not valid UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import pieces
from .chunks import Memo, chunks
from .columns import text_or_empty

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: A document over this many tokens is reported.
LIMIT = 512


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"tokenizers " + tokenizers.__version__.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def _loaded(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [x.content for x in tokenizer.get_added_tokens_decoder().values()], Memo()


def count_batch(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text. Distinct pieces are encoded once and remembered within the worker."""
    tokenizer, special, memo = _loaded(path)
    distinct, index, rows = chunks(texts, special)
    new = [x for x in distinct if x not in memo]
    counts = [len(e.ids) for e in tokenizer.encode_batch([x.decode("utf-8", "replace") for x in new], add_special_tokens=False)]
    fresh = dict(zip(new, counts, strict=True))
    per_piece = np.array([fresh[x] if x in fresh else memo[x] for x in distinct] or [0], np.int64)
    memo.keep(new, counts)
    total = np.concatenate([[0], np.cumsum(per_piece[index])]) if len(index) else np.zeros(1, np.int64)
    return total[rows[1:]] - total[rows[:-1]]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            yield pa.record_batch([batch.column(0), pa.array(count_batch(batch.column(1), path))], ["digest", "n_tokens"])

    return run


def open_cache(spark: SparkSession, cache: str) -> None:
    """Makes the cache readable where nothing has been written yet."""
    kinds = [x.split() for x in CACHE_SCHEMA.split(", ")]
    spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in kinds)).write.mode("append").parquet(cache)


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return stored.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, tokens, whether over ``limit``. Appends to ``cache`` what it did not hold."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    open_cache(spark, cache)
    digested = docs.select(F.col(id_name).alias("doc_id"), text_or_empty(text).alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text"), 256))
    )
    first = digested.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("first"))
    misses = first.join(cached_counts(spark, cache, version), "digest", "left_anti")
    chosen = digested.withColumn("first", F.coalesce("doc_id", F.lit(-1))).join(misses, ["digest", "first"], "left_semi")
    chosen = chosen.dropDuplicates(["digest", "first"])  # rows that occur twice; partitioned by the join already
    encoded = chosen.select("digest", "text").mapInArrow(_encode(path), "digest binary, n_tokens long")
    encoded.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    return (
        digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(cached_counts(spark, cache, version), "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
