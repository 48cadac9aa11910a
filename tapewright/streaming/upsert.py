"""Late or corrected dates replaced idempotently from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import replace_dates


def upsert_dates(stream: DataFrame, path: str, checkpoint: str, *, version: str = "version",
                 keys=("symbol", "date")):
    """Each micro-batch is merged into its own dates of the table at ``path``.

    The highest ``version`` of a key wins, over the batch and what is stored for its dates,
    so a date that arrives in parts keeps all parts and an old version changes nothing.  The
    merged dates are written aside before they replace the stored ones; writing a batch twice
    gives the same table.
    """
    others = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch, "upsert-batch")
        if batch.isEmpty():
            return
        if number == 0:
            replace_dates(batch.limit(0), path)
        dates = batch.select("date").distinct()
        stored = spark.read.schema(batch.schema).parquet(path).join(dates, "date", "left_semi").select(*batch.columns)
        newest = batch.union(stored).groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(version)).alias("r"))
        replace_dates(cut_lineage(newest.select(*keys, "r.*"), "upsert-merged"), path)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
