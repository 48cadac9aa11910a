"""Outcome labels computed from forward paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import exit_results, first_hit_label, horizon_max
from ..settings import DEFAULTS, HORIZONS, Thresholds
from .timeseries import add_segments, forward_returns, with_picks


def add_labels(panel: DataFrame, *, price: str = "price", t: Thresholds = DEFAULTS,
               keep_path: bool = False) -> DataFrame:
    """Horizon maxima, touched flags and the first-hit win label of a sheet history.

    The path array lives only inside this projection unless ``keep_path`` is set.
    """
    longest = max(max(HORIZONS), t.tradable_horizon)
    df = panel if "seg" in panel.columns else add_segments(panel, t=t)
    df = forward_returns(df, longest, price=price, max_abs=t.max_abs_return)
    out = {}
    for h in HORIZONS:
        peak = horizon_max(F.col("path"), h)
        out[f"future_max_{h}d"] = peak
        out[f"upside_touched_{h}d"] = (peak >= t.upside_pct).cast("int")
    out["tradable_win"] = first_hit_label(F.col("path"), t.tp_pct, t.sl_pct, t.tradable_horizon)
    df = df.withColumns(out)
    return df if keep_path else df.drop("path", "seg", "bars_since_gap")


def fixed_outcome(bars: DataFrame, *, bars_ahead: int = 20, tp: float = 0.20, sl: float = -0.08) -> DataFrame:
    """(symbol, date, fwd_max20, tpsl): plain 20-bar outcome without a gap guard."""
    df = forward_returns(bars, bars_ahead, gap_guard=False, scale=1.0)
    return df.select(
        "symbol", "date",
        horizon_max(F.col("path"), bars_ahead).alias("fwd_max20"),
        first_hit_label(F.col("path"), tp, sl, bars_ahead).alias("tpsl"),
    )


def exit_simulation(picks: DataFrame, indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per (pick, rule): the return of each exit rule over at most 40 bars.

    Picks with fewer than two later bars are left out.  ``picks`` holds each (symbol, date)
    at most once; it meets the bars before their paths exist, so paths are built for picks
    only, inside the symbol window, and are never shuffled.
    """
    bars = with_picks(indicators.select("symbol", "date", "close", "atr_pct"), picks.select("symbol", "date"))
    paths = forward_returns(bars, t.exit_cap_bars, gap_guard=False, scale=1.0)
    runs = paths.where(F.col("picked").isNotNull() & (F.size("path") >= 2))
    return runs.select(
        "symbol", "date", F.inline(exit_results(F.col("path"), F.col("atr_pct") / 100.0, t)))
