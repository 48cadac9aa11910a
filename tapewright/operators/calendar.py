"""Trading calendar: weekdays without holidays, missing days and date runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import HOLIDAYS_DDMMYYYY


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def is_trading_day(day: Column, holidays: list[str] | None = None) -> Column:
    """``holidays`` is a list of ddMMyyyy texts."""
    closed = HOLIDAYS_DDMMYYYY if holidays is None else holidays
    return is_weekday(day) & ~F.date_format(day, "ddMMyyyy").isin(*closed)


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every calendar date of each (start, end) row."""
    return bounds.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("date"))


def trading_days(spark: SparkSession, start, end, holidays: list[str] | None = None) -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return date_spine(bounds).where(is_trading_day(F.col("date"), holidays))


def previous_trading_day(day: Column, holidays: list[str] | None = None) -> Column:
    """Last trading day strictly before ``day``.

    Among one weekday more than there are holidays one must be open, so the look-back
    follows from the holiday list.  Most days are answered by the first two weeks.
    """
    closed = HOLIDAYS_DDMMYYYY if holidays is None else holidays

    def within(days: int) -> Column:
        before = F.sequence(F.date_sub(day, days), F.date_sub(day, 1))
        return F.array_max(F.filter(before, lambda d: is_trading_day(d, closed)))

    return F.coalesce(within(14), within(7 * (len(set(closed)) // 5 + 2)))


def missing_weekdays(dates: DataFrame, start=None, end=None) -> DataFrame:
    """Weekdays within the bounds (default: first to last date) that have no rows."""
    have = dates.select("date").distinct()
    lo = F.min("date") if start is None else F.lit(start).cast("date")
    hi = F.max("date") if end is None else F.lit(end).cast("date")
    spine = date_spine(have.agg(lo.alias("start"), hi.alias("end")))
    return spine.where(is_weekday(F.col("date"))).join(have, "date", "left_anti")


def date_runs(dates: DataFrame, max_gap_days: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last date and length of each run; a longer gap starts a new run.

    Dates are distinct per group, so a group is bounded by the calendar.
    """
    days = dates.select(*by, "date").distinct()
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("date")
    jump = F.coalesce((F.datediff("date", F.lag("date").over(w)) > max_gap_days).cast("int"), F.lit(0))
    runs = days.withColumn("_j", jump).withColumn(
        "run", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days")
    ).withColumn("run", F.col("run").cast("int"))
