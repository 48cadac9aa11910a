"""Per-symbol window operators over daily bars.

A bar table is unique on (symbol, date), so one symbol never has more rows than
there are calendar days (about 36,500 per century).  That bounds every window
partition below no matter how large the table or how popular the symbol, and all
operators here share one shuffle by symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import is_true
from ..settings import DEFAULTS, TRUSTED_AFTER_BARS, Thresholds


def by_symbol():
    """The window of one symbol in date order."""
    return Window.partitionBy("symbol").orderBy("date")



def trailing(fn, value: Column, bars: int, min_bars: int | None = None, window=None) -> Column:
    """``fn`` over the last ``bars`` rows, NULL until ``min_bars`` non-null values exist."""
    frame = (window or by_symbol()).rowsBetween(-(bars - 1), 0)
    need = bars if min_bars is None else min_bars
    return F.when(F.count(value).over(frame) >= need, fn(value).over(frame))


def stacked(block: Column, size: int, blocks: int, window) -> list[Column]:
    """The value of a ``size``-row block ending here and of the blocks just before it."""
    return [block if i == 0 else F.lag(block, i * size).over(window) for i in range(blocks)]


def total_of(blocks: list[Column]) -> Column:
    """Sum of consecutive blocks; unknown unless every block is complete."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out + b
    return out


def add_segments(bars: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """``seg`` counts jumps of more than ``max_gap_days``; ``bars_since_gap`` is 1-based.

    The bar position within a segment is the row number minus the row number of the
    latest segment start, so no second sort is needed.
    """
    jump = F.coalesce(
        (F.datediff("date", F.lag("date").over(by_symbol())) > t.max_gap_days).cast("int"), F.lit(0))
    numbered = bars.withColumn("_jump", jump).withColumn("_rn", F.row_number().over(by_symbol()))
    so_far = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("seg", F.sum("_jump").over(so_far).cast("int"))
        .withColumn("_start", F.max(F.when((F.col("_jump") == 1) | (F.col("_rn") == 1), F.col("_rn"))).over(so_far))
        .withColumn("bars_since_gap", (F.col("_rn") - F.col("_start") + 1).cast("int"))
        .drop("_jump", "_rn", "_start")
    )


def add_true_range(bars: DataFrame) -> DataFrame:
    """Day range, or on later bars of a segment the wider span including the previous close."""
    prev = F.lag("close").over(by_symbol())
    day = F.col("high") - F.col("low")
    wide = F.greatest(day, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return bars.withColumn("tr", F.when(F.col("bars_since_gap") == 1, day).otherwise(wide))


def trend_template() -> Column:
    """Stacked averages, a rising long average, near the high and well off the low."""
    close, s50, s150, s200 = (F.col(c) for c in ("close", "sma50", "sma150", "sma200"))
    return (
        is_true(close > s50) & is_true(s50 > s150) & is_true(s150 > s200)
        & is_true(s200 > F.lag("sma200", 20).over(by_symbol()))
        & is_true(F.col("pct_from_52w_high") >= -25)
        & is_true(F.col("pct_from_52w_low") >= 30)
    )


def mask_untrusted(df: DataFrame) -> DataFrame:
    """Blank every indicator that has less contiguous history than it needs."""
    masked = {
        c: F.when(F.col("bars_since_gap") >= need, F.col(c))
        for c, need in TRUSTED_AFTER_BARS.items() if c in df.columns
    }
    return df.withColumns(masked)


def add_indicators(bars: DataFrame, *, strict_segments: bool = False, t: Thresholds = DEFAULTS) -> DataFrame:
    """All per-symbol indicators of a bar table.

    Rolling windows run over the whole symbol and are then masked by contiguous
    history; ``strict_segments`` restricts the windows themselves to one segment.

    A sliding frame re-reads its rows for every bar, so the long windows are put together
    from short blocks: 20 and 50 bars from ten-bar sums, 150 and 200 from those of 50, the
    year from 21-bar extremes (252 = 3 x 4 x 21).  Nothing is ever subtracted, so no precision is lost.
    """
    df = add_true_range(add_segments(bars, t=t))
    w = Window.partitionBy("symbol", "seg").orderBy("date") if strict_segments else by_symbol()
    close, tr = F.col("close"), F.col("tr")
    if t.year_bars % 12:
        raise ValueError("year_bars must be a multiple of 12")
    month = t.year_bars // 12
    frame = w.rowsBetween(-(month - 1), 0)
    df = df.withColumns({
        "_c10": trailing(F.sum, close, 10, None, w),
        "_t5": trailing(F.sum, tr, 5, None, w),
        "_v20": trailing(F.avg, F.col("volume").cast("double"), 20, None, w),
        "_hi": F.max(close).over(frame),
        "_lo": F.min(close).over(frame),
        "_seen": F.count(close).over(w.rowsBetween(-(t.year_min_bars - 1), 0)),
        "atr14": trailing(F.avg, tr, 14, 7, w),
        "ret_20d": F.try_divide(close, F.lag("close", 20).over(w)) - 1,
    })
    tens = stacked(F.col("_c10"), 10, 5, w)
    df = df.withColumns({
        "sma20": total_of(tens[:2]) / 20,
        "_c50": total_of(tens),
        "_hi": F.greatest(*stacked(F.col("_hi"), month, 4, w)),
        "_lo": F.least(*stacked(F.col("_lo"), month, 4, w)),
        "range_contraction_ratio": F.try_divide(
            F.col("_t5") / 5, total_of(stacked(F.col("_t5"), 5, 4, w)) / 20),
        "rel_volume": F.try_divide(F.col("volume"), F.col("_v20")),
        "atr_pct": F.try_divide(F.col("atr14"), close) * 100,
    })
    fifties = stacked(F.col("_c50"), 50, 4, w)
    df = df.withColumns({
        "sma50": F.col("_c50") / 50,
        "sma150": total_of(fifties[:3]) / 150,
        "sma200": total_of(fifties) / 200,
        "_hi": F.greatest(*stacked(F.col("_hi"), 4 * month, 3, w)),
        "_lo": F.least(*stacked(F.col("_lo"), 4 * month, 3, w)),
    })
    long_enough = F.col("_seen") >= t.year_min_bars
    df = df.withColumns({
        "pct_from_52w_high": F.when(long_enough, (F.try_divide(close, F.col("_hi")) - 1) * 100),
        "pct_from_52w_low": F.when(long_enough, (F.try_divide(close, F.col("_lo")) - 1) * 100),
    })
    df = df.withColumn("trend_template_pass", trend_template())
    return mask_untrusted(df).drop("tr", "_c10", "_c50", "_t5", "_v20", "_hi", "_lo", "_seen")


def benchmark_returns(indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    return indicators.where(F.col("symbol") == t.benchmark).select(
        "date", F.col("ret_20d").alias("benchmark_ret_20d"))


def add_relative_strength(indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Percentage points of 20-bar return above the benchmark's; unknown without it.

    The joined side has at most one row per calendar date.
    """
    bench = benchmark_returns(indicators, t=t)
    return indicators.join(bench, "date", "left").withColumn(
        "rs_vs_market", (F.col("ret_20d") - F.col("benchmark_ret_20d")) * 100)


def add_delivery_ratio(bars: DataFrame) -> DataFrame:
    """Delivery share against its own 20-bar mean (at least 5 values)."""
    return bars.withColumn(
        "deliv_ratio", F.try_divide(F.col("deliv_per"), trailing(F.avg, F.col("deliv_per"), 20, 5)))


def add_gap_features(bars: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Opening gap, place of the close in the day's range, and episodic-pivot flags.

    A day without a usable range still counts as a pivot.  Needs ``rel_volume``.
    """
    prev = F.lag("close").over(by_symbol())
    df = bars.withColumns({
        "gap_pct": F.when(prev > 0, (F.try_divide(F.col("open"), prev) - 1) * 100),
        "close_pos": F.when(
            F.col("high") > F.col("low"),
            (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))),
    })
    raw = is_true(F.col("gap_pct") >= t.pivot_gap_pct) & is_true(F.col("rel_volume") >= t.pivot_rel_volume)
    held = is_true(F.col("close_pos") >= 0.5)
    return df.withColumns({
        "ep_raw": raw,
        "ep": raw & (held | F.col("close_pos").isNull()),
        "ep_fade": raw & F.col("close_pos").isNotNull() & ~held,
    })


def add_persistence(indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Leader days among the symbol's own last 20 rows (at least 5 rows)."""
    lead = is_true(F.col("rs_vs_market") >= t.leader_rs).cast("int")
    return indicators.withColumn("persist20", trailing(F.sum, lead, 20, 5))


def latest_as_of(df: DataFrame, as_of=None, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Last row per symbol on or before ``as_of``, dropped when too old to trust.

    An aggregate with map-side combine, so no symbol's history is gathered in a task.
    """
    rows = df if as_of is None else df.where(F.col("date") <= F.lit(as_of).cast("date"))
    others = [c for c in df.columns if c != "symbol"]
    last = rows.groupBy("symbol").agg(F.max_by(F.struct(*others), F.col("date")).alias("r"))
    last = last.select("symbol", "r.*")
    if as_of is None:
        return last
    return last.where(F.datediff(F.lit(as_of).cast("date"), F.col("date")) <= t.stale_after_days)


def post_signal_stats(bars: DataFrame, signal_date) -> DataFrame:
    """Latest close and earliest highest close per symbol from ``signal_date`` on."""
    after = bars.where(F.col("date") >= F.lit(signal_date).cast("date"))
    peak = F.max(F.struct("close", (-F.unix_date("date")).alias("neg_day")))
    return after.groupBy("symbol").agg(
        F.max("date").alias("latest_date"),
        F.max_by("close", "date").alias("latest_price"),
        peak.alias("_peak"),
    ).select(
        "symbol", "latest_date", "latest_price",
        F.date_from_unix_date(-F.col("_peak.neg_day")).alias("peak_date"),
        F.col("_peak.close").alias("peak_price"),
    )


def forward_returns(df: DataFrame, bars: int, *, price: str = "close", gap_guard: bool = True,
                    max_abs: float | None = None, scale: float = 100.0, name: str = "path") -> DataFrame:
    """Array of the next ``bars`` returns of ``price``, cut at the first unusable entry.

    ``gap_guard`` needs ``seg`` and stops at its end.  Offsets share the sort of the
    symbol windows and carry scalars, not growing lists.
    """
    from ..functions.paths import usable_prefix

    keys = ["symbol", "seg"] if gap_guard else ["symbol"]
    w = Window.partitionBy(*keys).orderBy("date")
    ahead = F.array(*[F.lead(price, k).over(w) for k in range(1, bars + 1)])
    df = df.withColumn("_ahead", ahead)
    base = F.when(F.col(price) > 0, F.col(price))
    rets = F.transform("_ahead", lambda p: (F.when(p > 0, p) / base - 1.0) * scale)
    return df.withColumn(name, usable_prefix(rets, max_abs)).drop("_ahead")


def with_picks(bars: DataFrame, picks: DataFrame) -> DataFrame:
    """Every bar, with the other columns of its pick as the struct ``picked`` (NULL where there is none).

    ``picks`` holds each (symbol, date) at most once.  Both sides are narrow here; what is
    derived from later bars comes after this join.
    """
    others = [c for c in picks.columns if c not in ("symbol", "date")]
    marked = picks.select("symbol", "date", F.struct(F.lit(True).alias("_is"), *others).alias("picked"))
    return bars.join(marked, ["symbol", "date"], "left")
