"""Score a sheet: the live candidate list and the retroactive history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.screeners import names_in, points_of, tag_screeners
from ..operators.labels import add_labels
from ..operators.ranking import percentile_rank, positions
from ..operators.timeseries import latest_as_of, post_signal_stats
from ..settings import DEFAULTS, Thresholds


def add_score(sheet: DataFrame, *, weights: Column | None = None, cap_confluence: int | None = None,
              t: Thresholds = DEFAULTS) -> DataFrame:
    """Score columns of rows that carry ``volume_pct`` and ``rs_vs_market``."""
    c = F.col
    tagged = sheet.withColumns({
        "_tags": tag_screeners(c("screeners")), "triggers": S.fresh_triggers(c("new_screeners"))})
    df = tagged.withColumns({
        "breakout": names_in(c("_tags"), "breakout"),
        "momentum": names_in(c("_tags"), "momentum"),
        "base": names_in(c("_tags"), "base"),
        "pattern_points": points_of(F.transform("_tags", lambda x: x["norm"]), weights, t),
        "confluence_points": S.confluence_score(c("today_count"), c("count_diff"), c("triggers"), cap_confluence),
        "momentum_points": S.momentum_volume_score(c("chg"), c("volume_pct"), t),
        "institutional_points": S.institutional_score(c("buy_qty"), c("sell_qty"), t),
        "rs_points": S.relative_strength_score(c("rs_vs_market"), t),
    }).drop("_tags")
    plain = [c("pattern_points"), c("confluence_points"), c("momentum_points"), c("institutional_points")]
    return df.withColumns({
        "score": S.total_score(*plain, c("rs_points")),
        "score_no_rs": S.total_score(*plain),
        "setup_type": S.setup_type(c("breakout"), c("momentum"), c("base")),
        "has_breakout_pattern": F.size("breakout") > 0,
        "rule_phase": S.rule_phase(F.array_join("screeners", ", "), c("count_diff")),
    })


def score_history(sheet: DataFrame, indicators: DataFrame, *, weights: Column | None = None,
                  t: Thresholds = DEFAULTS) -> DataFrame:
    """Score every historical row; the volume percentile is taken before the gate."""
    known = indicators.select("symbol", "date", "rs_vs_market", "atr_pct", "rel_volume")
    ranked = percentile_rank(sheet, ["date"], "volume", "volume_pct")
    return add_score(ranked.join(known, ["symbol", "date"], "left"), weights=weights, t=t)


def labeled_history(sheet: DataFrame, indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Scored history with outcome labels.

    Labels need only (symbol, date, price), so they are computed on those three columns
    and joined; the wide rows never pass through the symbol windows.  ``sheet`` is read
    more than once: pass a stored table.
    """
    labels = add_labels(sheet.select("symbol", "date", "price"), t=t).drop("price")
    return score_history(sheet, indicators, t=t).join(labels, ["symbol", "date"], "left")


def backtest_gate(df: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Liquidity gate of the backtest; rows without a sector pass."""
    c = F.col
    return df.where(S.liquidity_gate(c("symbol"), c("price"), c("volume"), c("sector"), require_sector=False, t=t))


def live_gate(df: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    c = F.col
    return df.where(S.liquidity_gate(c("symbol"), c("price"), c("volume"), c("sector"), require_sector=True, t=t))


def score_watchlist(sheet: DataFrame, bars: DataFrame | None = None, indicators: DataFrame | None = None,
                    *, signal_date=None, percentile_scope: str = "gated", by: tuple[str, ...] = (),
                    weights: Column | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """Ranked candidate list of a sheet.

    ``indicators`` and ``bars`` may be left out: the relative-strength points are then 0,
    the stop is flat and the since-signal columns are empty.  With ``by=("date",)`` every
    date of a history is ranked at once and indicators are matched on the date.
    """
    if percentile_scope not in ("gated", "all"):
        raise ValueError("percentile_scope is 'gated' or 'all'")
    keys = ["symbol", *by]
    group = list(by) or ["_one"]
    df = sheet if by else sheet.withColumn("_one", F.lit(0))
    if percentile_scope == "gated":
        df = percentile_rank(live_gate(df, t=t), group, "volume", "volume_pct")
    else:
        df = live_gate(percentile_rank(df, group, "volume", "volume_pct"), t=t)
    if indicators is not None:
        snap = indicators if by else latest_as_of(indicators, signal_date, t=t)
        df = df.join(snap.select(*keys, "rs_vs_market", "atr_pct"), keys, "left")
    else:
        df = df.withColumns({"rs_vs_market": F.lit(None).cast("double"), "atr_pct": F.lit(None).cast("double")})
    if bars is not None and signal_date is not None:
        df = df.join(post_signal_stats(bars, signal_date), "symbol", "left")
    else:
        df = df.withColumns({
            "latest_date": F.lit(None).cast("date"), "latest_price": F.lit(None).cast("double"),
            "peak_date": F.lit(None).cast("date"), "peak_price": F.lit(None).cast("double")})
    return rank_candidates(explain_candidates(add_score(df, weights=weights, t=t), t=t), by=by).drop("_one")


def explain_candidates(scored: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Levels, moves since the signal and the reasoning text."""
    c = F.col
    df = scored.withColumn("_levels", S.risk_levels(c("price"), c("atr_pct"), t))
    return df.withColumns({
        "target_price": c("_levels.target_price"),
        "target_pct": c("_levels.target_pct"),
        "stop_price": c("_levels.stop_price"),
        "stop_pct": c("_levels.stop_pct"),
        "rr": c("_levels.rr"),
        "stop_basis": c("_levels.basis"),
        "chg_since_signal": S.pct_move(c("price"), c("latest_price")),
        "chg_to_peak": S.pct_move(c("price"), c("peak_price")),
        "reasoning": S.reasoning(
            c("breakout"), c("momentum"),
            S.confluence_note(c("count_diff"), c("triggers")),
            S.momentum_note(c("chg"), c("volume_pct")),
            S.institutional_note(c("buy_qty"), c("sell_qty")),
            S.relative_strength_note(c("rs_vs_market"))),
    }).drop("_levels")


def rank_candidates(scored: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Full ranking by score, ties by symbol, written once and numbered by ranges.

    A sheet of any size, also one where most rows share a score, is ranked by many tasks.
    """
    return positions(scored, list(by), [F.col("score").desc(), F.col("symbol").asc()], "rank")


def shortlist(ranked: DataFrame, *, min_score: float | None = None, size: int | None = None,
              t: Thresholds = DEFAULTS) -> DataFrame:
    """Best-scored candidates at or above the floor (a top-k report)."""
    floor = t.min_score if min_score is None else min_score
    n = t.shortlist_size if size is None else size
    return ranked.where(F.col("score") >= floor).orderBy("rank").limit(n)
