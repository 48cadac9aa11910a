"""Forward as-of lookups: the first bar on or after an event's date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_calendar(bars: DataFrame) -> DataFrame:
    """(date, session, prev_date) of all trading dates; bounded by the calendar.

    The dates are distinct before they are gathered, so the array holds one entry per
    calendar day whatever the size of the table.
    """
    dates = bars.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("d"))
    numbered = F.transform("d", lambda day, i: F.struct(
        day.alias("date"), (i + 1).cast("int").alias("session"),
        F.try_element_at("d", F.nullif(i, F.lit(0))).alias("prev_date")))
    return dates.select(F.inline(numbered))


def next_session(events: DataFrame, bars: DataFrame, event_date: str, name: str = "date") -> DataFrame:
    """Map each event date to the first trading date on or after it (market calendar).

    Distinct dates of both sides are merged and looked at forward; the resulting map has
    one row per calendar date.  An event time counts by its date.
    """
    events = events.withColumn(event_date, F.col(event_date).cast("date"))
    cal = bars.select(F.col("date").cast("date").alias("d")).distinct().withColumn("_session", F.col("d"))
    asked = events.select(F.col(event_date).alias("d")).distinct().withColumn(
        "_session", F.lit(None).cast("date"))
    spine = cal.unionByName(asked).groupBy("d").agg(F.max("_session").alias("_session"))
    # One row per calendar date: bounded, so a single ordered pass is enough.
    ahead = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    mapped = spine.select(
        F.col("d").alias(event_date), F.first("_session", ignorenulls=True).over(ahead).alias(name))
    return events.join(mapped, event_date, "left")


def next_bar_map(events: DataFrame, bars: DataFrame, event_date: str, name: str = "date") -> DataFrame:
    """(symbol, event_date, name): first bar of that symbol on or after each event date.

    Event dates are made distinct per symbol first, so a symbol with most of the events
    still contributes at most one row per calendar day.
    """
    asked = events.select("symbol", F.col(event_date).alias("_d")).distinct()
    marks = asked.select("symbol", "_d", F.lit(0).alias("_kind"), F.lit(None).cast("date").alias("_bar"))
    own = bars.select("symbol", F.col("date").alias("_d"), F.lit(1).alias("_kind"), F.col("date").alias("_bar"))
    ahead = (Window.partitionBy("symbol").orderBy("_d", "_kind")
             .rowsBetween(0, Window.unboundedFollowing))
    return (
        marks.unionByName(own)
        .withColumn(name, F.first("_bar", ignorenulls=True).over(ahead))
        .where(F.col("_kind") == 0)
        .select("symbol", F.col("_d").alias(event_date), name)
    )


def bars_before_map(positions: DataFrame, bars: DataFrame, at: str, name: str = "bars_before") -> DataFrame:
    """(symbol, at, name): how many bars the symbol has up to and including each date."""
    asked = positions.select("symbol", F.col(at).alias("_d")).distinct().withColumn("_bar", F.lit(0))
    own = bars.select("symbol", F.col("date").alias("_d"), F.lit(1).alias("_bar"))
    # RANGE ordering: a bar on the date itself is counted.
    so_far = Window.partitionBy("symbol").orderBy("_d").rangeBetween(Window.unboundedPreceding, 0)
    return (
        asked.unionByName(own).withColumn(name, F.sum("_bar").over(so_far))
        .where(F.col("_bar") == 0).select("symbol", F.col("_d").alias(at), name)
    )
