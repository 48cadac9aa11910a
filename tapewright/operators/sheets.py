"""Daily sheet: screener hits, delivery, deals and sectors joined per symbol and date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.screeners import new_screeners, screener_count
from .asof import session_calendar
from .timeseries import by_symbol

HIT_ATTRIBUTES = ["stock_name", "chg", "price", "volume"]


def merge_hits(hits: DataFrame, keys=("symbol",)) -> DataFrame:
    """One row per key: sorted distinct screeners, first known attributes, frequency.

    The set per key is bounded by the number of configured screeners.
    """
    known = [c for c in HIT_ATTRIBUTES if c in hits.columns]
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("screener"))).alias(c) for c in known]
    merged = hits.groupBy(*keys).agg(F.sort_array(F.collect_set("screener")).alias("screeners"), *first)
    return merged.withColumn("frequency", F.size("screeners"))


def recent_dates(df: DataFrame, limit: int = 2, on_or_before=None) -> DataFrame:
    """The most recent distinct dates, newest first."""
    dates = df.select("date").distinct()
    if on_or_before is not None:
        dates = dates.where(F.col("date") <= F.lit(on_or_before).cast("date"))
    return dates.orderBy(F.col("date").desc()).limit(limit)


def compare_with_previous(today: DataFrame, previous: DataFrame) -> DataFrame:
    """Today's merged hits beside the previous sheet's, with the change measures."""
    prev = previous.select(
        "symbol", F.lit(True).alias("_seen"), F.col("screeners").alias("prev_screeners"),
        F.col("chg").alias("prev_chg"))
    return _with_changes(today.join(prev, "symbol", "left"))


def compare_history(merged: DataFrame) -> DataFrame:
    """The same comparison for every date at once.

    The previous row of a symbol counts only when it is from the previous sheet date, so
    a window over the symbol replaces a self-join.
    """
    cal = session_calendar(merged).select("date", "prev_date")
    seen = F.lag("date").over(by_symbol()) == F.col("prev_date")
    df = merged.join(cal, "date")
    df = df.withColumns({
        "_seen": seen,
        "prev_screeners": F.when(seen, F.lag("screeners").over(by_symbol())),
        "prev_chg": F.when(seen, F.lag("chg").over(by_symbol())),
    })
    return _with_changes(df).drop("prev_date")


def _with_changes(df: DataFrame) -> DataFrame:
    today, prev = F.col("screeners"), F.col("prev_screeners")
    return df.withColumns({
        "was_in_previous_sheet": F.coalesce(F.col("_seen"), F.lit(False)),
        "chg_wrt_previous": F.round(F.col("chg") - F.col("prev_chg"), 2),
        "today_count": screener_count(today),
        "count_diff": screener_count(today) - screener_count(prev),
        "new_screeners": new_screeners(today, prev),
    }).drop("_seen")


def deals_summary(deals: DataFrame, keys=("symbol",), prefix: str = "") -> DataFrame:
    """Quantity and count by side as four columns; an absent side is 0."""
    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("quantity")).otherwise(0.0))

    return deals.groupBy(*keys).agg(
        total("BUY").alias(f"{prefix}buy_quantity"),
        total("SELL").alias(f"{prefix}sell_quantity"),
        F.count_if(F.col("side") == "BUY").alias(f"{prefix}buy_count"),
        F.count_if(F.col("side") == "SELL").alias(f"{prefix}sell_count"),
    )


def deals_by_kind(deals: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Bulk and block summaries side by side in one aggregation; NULL where a kind is absent."""
    def total(kind: str, side: str) -> Column:
        mine = F.col("kind") == kind
        return F.when(
            F.count_if(mine) > 0,
            F.sum(F.when(mine & (F.col("side") == side), F.col("quantity")).otherwise(0.0)))

    return deals.groupBy(*keys).agg(*[
        total(k, s).alias(f"{k}_{s.lower()}_quantity") for k in ("bulk", "block") for s in ("BUY", "SELL")])


def delivery_averages(delivery: DataFrame, target) -> DataFrame:
    """Latest row and 3/5/10-row means per symbol that traded on the target date.

    Only rows up to the target are read, so a back-dated run gives the same answer later.
    """
    rows = delivery.where(F.col("date") <= F.lit(target).cast("date"))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    recent = rows.withColumn("_rn", rn).where(F.col("_rn") <= 10)
    means = [
        F.avg(F.when(F.col("_rn") <= n, F.col(c))).alias(f"avg{n}_{c}")
        for c in ("deliv_qty", "deliv_per") for n in (3, 5, 10)
    ]
    return recent.groupBy("symbol").agg(
        F.max("date").alias("latest_date"),
        F.max_by("deliv_qty", "date").alias("deliv_qty"),
        F.max_by("deliv_per", "date").alias("deliv_per"),
        *means,
    ).where(F.col("latest_date") == F.lit(target).cast("date"))


def delivery_pivot(delivery: DataFrame, target=None, days: int = 7, *, by_recency: bool = False) -> DataFrame:
    """Sum of quantity and mean share for each of the last ``days`` dates.

    Columns are named by date, or with ``by_recency`` by age (d1 is the newest).  Only
    those few dates reach the driver.
    """
    dates = [r[0] for r in recent_dates(delivery, days, target).collect()]
    rows = delivery.where(F.col("date").isin(dates))
    out = []
    for i, d in enumerate(dates, 1):
        label = f"d{i}" if by_recency else f"{d:%Y%m%d}"
        mine = F.col("date") == F.lit(d)
        out.append(F.sum(F.when(mine, F.col("deliv_qty"))).alias(f"{label}_deliv_qty"))
        out.append(F.avg(F.when(mine, F.col("deliv_per"))).alias(f"{label}_deliv_per"))
    return rows.groupBy("symbol").agg(*out)


def assemble_sheet(*parts: DataFrame | None) -> DataFrame:
    """Full outer join of the given per-symbol tables; absent inputs are skipped."""
    given = [p for p in parts if p is not None]
    if not given:
        raise ValueError("no tables to assemble")
    return reduce(lambda a, b: a.join(b, "symbol", "full_outer"), given)


def attach_sectors(sheet: DataFrame, sectors: DataFrame) -> DataFrame:
    """Rows without a change value or without a sector are dropped."""
    rows = sheet.where(F.col("chg").isNotNull()) if "chg" in sheet.columns else sheet
    return rows.join(sectors, "symbol")


def sheet_history(hits: DataFrame, bars: DataFrame, deals: DataFrame, sectors: DataFrame) -> DataFrame:
    """One scored-ready row per symbol and date for the whole history."""
    quotes = bars.withColumn(
        "chg", (F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1) * 100
    ).select("symbol", "date", F.col("close").alias("price"), "chg", "volume", "deliv_per")
    merged = merge_hits(hits, ("symbol", "date")).join(quotes, ["symbol", "date"])
    compared = compare_history(merged)
    flows = deals_by_kind(deals)
    return (
        compared.join(sectors, "symbol").join(flows, ["symbol", "date"], "left")
        .withColumns({
            "buy_qty": F.coalesce("bulk_buy_quantity", "block_buy_quantity"),
            "sell_qty": F.coalesce("bulk_sell_quantity", "block_sell_quantity"),
        })
    )
