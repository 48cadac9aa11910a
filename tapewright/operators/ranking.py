"""Cross-sectional ranks, quantiles and top-k per group that survive a hot group.

A date can hold any number of symbols, so no operator here sends all rows of one
group to one task: values are counted with map-side combine, counts are split by an
order-preserving bucket, and only bucket totals (a bounded number per group) are
accumulated across the group.  Full orderings are cut into ranges instead, and only the
ranges' sizes are accumulated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def order_bucket(value: Column, resolution: int = 16) -> Column:
    """A coarse integer that never decreases as ``value`` grows (16 steps per power of 2).

    Infinities lie beyond all other numbers, and NaN, which Spark sorts last, beside the greatest.
    """
    v = value.cast("double")
    step = F.floor(F.least(F.log2(F.abs(v)), F.lit(1024.0)) * resolution).cast("long") + F.lit(1100 * resolution)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v < 0, -step).otherwise(step))


def value_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """One row per distinct non-null value: ``n_less``, ``ties`` and group size ``n``.

    A row counts as ``weight`` rows where that is given (a frame counted before).
    """
    by = list(by)
    ties = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(ties.alias("ties"))
        .withColumn("_bucket", order_bucket(F.col(value)))
    )
    across = Window.partitionBy(*by).orderBy("_bucket")
    offsets = counts.groupBy(*by, "_bucket").agg(F.sum("ties").alias("_size")).select(
        *by, "_bucket",
        F.coalesce(F.sum("_size").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"),
        F.sum("_size").over(Window.partitionBy(*by)).alias("n"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(offsets, [*by, "_bucket"]).select(
        *by, value,
        (F.col("_below") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("n_less"),
        "ties", "n",
    )


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Average-tie rank divided by the group's non-null count; NULL values stay NULL."""
    by = list(by)
    ranks = value_ranks(df, by, value).select(
        *by, value, ((F.col("n_less") + (F.col("ties") + 1) / 2) / F.col("n")).alias(name))
    return df.join(ranks, [*by, value], "left")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    by = list(by)
    ranks = value_ranks(df, by, value).select(
        *by, value, (F.col("n_less") + (F.col("ties") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def group_quantile(df: DataFrame, by: Sequence[str], value: str, q: float, name: str) -> DataFrame:
    """Exact linearly interpolated quantile per group."""
    by = list(by)
    at = F.col("_pos")
    low_hit = (F.col("n_less") <= F.floor(at)) & (F.floor(at) < F.col("n_less") + F.col("ties"))
    high_hit = (F.col("n_less") <= F.ceil(at)) & (F.ceil(at) < F.col("n_less") + F.col("ties"))
    ranks = value_ranks(df, by, value).withColumn("_pos", (F.col("n") - 1) * F.lit(float(q)))
    low, high = F.col("_low"), F.col("_high")
    return (
        ranks.groupBy(*by).agg(
            F.max(F.when(low_hit, F.col(value))).alias("_low"),
            F.max(F.when(high_hit, F.col(value))).alias("_high"),
            F.max(at - F.floor(at)).alias("_frac"),
        ).select(*by, (low + (high - low) * F.col("_frac")).alias(name))
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str | None = None) -> DataFrame:
    """First ``k`` rows per group; Spark limits each map task to ``k`` rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    rank = name or "_rank"
    out = df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return out if name else out.drop(rank)


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in its group's order, however large one group is.

    Rows are cut into ranges of (group, order), so a group that holds most rows lies in many
    ranges; the ranges are written once, with each row's place in its range, and a row's
    position is that place shifted by the group's rows in the ranges before.  ``order`` should
    be total: rows equal in all of it share a range and are numbered in an arbitrary order.
    """
    by = list(by)
    keys = [*(F.col(c).asc() for c in by), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    stored = cut_lineage(placed, "positions").withColumn("_range", F.shiftright("_at", 33))
    sizes = stored.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    # a group has one row per range here
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1)
    return (
        stored.alias("k").join(shifts.alias("o"), same_keys([*by, "_range"]))
        .select("k.*", (F.col("k._at") + F.col("o._shift")).cast("int").alias(name))
        .drop("_at", "_range")
    )


def same_keys(names: Sequence[str], left: str = "k", right: str = "o") -> Column:
    """Equality of all ``names`` of two aliased frames; NULL equals NULL."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


def add_deciles(counts: DataFrame, by: Sequence[str], score: str, n: str, name: str = "decile") -> DataFrame:
    """Decile of each distinct score, of any numeric domain, from a frame counted per (group, score).

    Edges are linearly interpolated, coinciding edges are merged, and groups with fewer
    than two scores are dropped, as are rows whose group is NULL.  The edges come from cumulative counts by one aggregate with
    map-side combine: a group's scores are never listed in one row or one task.
    """
    by = list(by)
    ranked = value_ranks(counts, by, score, n)
    value = F.col(score).cast("double")

    # Evenly spaced as i * 0.1 (not i / 10): the binary values decide which edges coincide.
    fractions = [*(i * 0.1 for i in range(10)), 1.0]
    ends, edges = [], []
    for i, q in enumerate(fractions):
        pos = (F.col("n") - 1) * F.lit(q)
        for side, at in (("low", F.floor(pos)), ("high", F.ceil(pos))):
            hit = (F.col("n_less") <= at) & (at < F.col("n_less") + F.col("ties"))
            ends.append(F.max(F.when(hit, value)).alias(f"_{side}{i}"))
        low, high, frac = F.col(f"_low{i}"), F.col(f"_high{i}"), pos - F.floor(pos)
        edges.append(F.when(frac >= 0.5, high - (high - low) * (1 - frac)).otherwise(low + (high - low) * frac))
    cuts = (
        ranked.groupBy(*by).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("_distinct"), *ends)
        .where(F.col("_distinct") >= 2).select(*by, F.array_distinct(F.array(*edges)).alias("_edges"))
    )
    below = F.size(F.filter("o._edges", lambda e: e < F.col(f"k.{score}").cast("double")))
    return (
        counts.where(F.col(score).isNotNull()).alias("k").join(cuts.alias("o"), by)
        .select("k.*", F.greatest(below - 1, F.lit(0)).cast("int").alias(name))
    )
