"""A training-data pipeline of five stages over the documents table.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that its predecessor kept; its result is
written as Parquet in the shared folder and read again by the next. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe_automaton, decontaminate, jaccard, language, superkmers
from tapewright.llm.windows import keyed
from tapewright.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"
#: Near copies share this percentage of their distinct shingles of so many words.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80
#: Rows per Arrow batch: whole texts travel to Python and back, so the usual ten thousand rows may fill a worker.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; the others have no language and go. ``lang`` becomes the language of the text; a label
    stays only where there is none to learn from."""
    _small_batches(spark)
    model = language.train(docs.select("text", "lang"))
    found = language.identify(docs.where(F.col("text").rlike(r"\p{L}")), model, carry=COLUMNS[1:])
    told = F.nullif(F.col("lang_pred"), F.lit(language.UNDETERMINED))
    return found.withColumn("lang", F.coalesce(told, "lang")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones; documents without words stay.

    Groups are told apart by their sets, so unlike documents that share an id, or have none, are all kept. Among copies
    that share an id one stays, whatever their other columns; a null id counts as greater than all ids.
    """
    groups = jaccard.similar_groups(docs, NEAR_PERCENT, shingle=NEAR_SHINGLE).where("n_shingles > 0")
    winners = groups.groupBy("group").agg(F.min(F.struct("id", "hash")).alias("w")).select("w.id", "w.hash").distinct()
    rows = keyed(docs, carry=COLUMNS)
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(worded).join(winners, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.union(rows.where(~worded)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(COLUMNS)))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document; words of passages that an earlier document has are cut out. Texts without such words stay as they are."""
    own = docs.select(*(F.col(c).alias(f"own_{c}") for c in COLUMNS))
    found = superkmers.dedup_words(own, id_name="own_doc_id", text="own_text", carry=tuple(own.columns))
    cut = F.col("n_removed") > 0
    return found.select(
        F.col("own_doc_id").alias("doc_id"),
        F.when(cut, F.col("kept")).otherwise(F.col("own_text")).alias("text"),
        F.col("own_lang").alias("lang"),
        F.col("own_source").alias("source"),
        F.when(cut, F.length("kept").cast("long")).otherwise(F.col("own_n_chars")).alias("n_chars"),
    )


def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, n_tokens, ids, text): language, token ids and the text they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    keyed_docs = docs.select(F.struct("doc_id", "lang").alias("key"), "text")
    coded = bpe_automaton.code_documents(keyed_docs, path, id_name="key")
    return coded.select("doc_id.doc_id", "doc_id.lang", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", remove_benchmark_items),
    ("bpe", encode),
]

#: Several stages, above all the trained language model and the benchmark search, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
