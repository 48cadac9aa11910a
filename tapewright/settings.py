"""Thresholds used across the package, as one immutable record of defaults."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Tuned constants, word lists and lookup tables whose content
# decides the results, so they are stated literally.
# ---------------------------------------------------------------------------
EQUITY_SERIES = ["EQ", "BE", "BZ"]
TRADE_TO_TRADE_SERIES = ["BE", "BZ"]
HORIZONS = [5, 10, 15, 20, 30]
TP_GRID = [5, 8, 10, 12, 15, 18, 20, 25, 30, 40]
SL_GRID = [5, 6, 8, 10, 12]
HORIZON_GRID = [10, 15, 20, 30]
COMBO_TP_GRID = [20, 25, 30]
COMBO_SL_GRID = [5, 6, 8]
COMBO_HORIZON_GRID = [10, 15, 30]
HOLIDAYS_DDMMYYYY = [
    "15082025", "27082025", "02102025", "21102025", "22102025", "05112025", "25122025",
]
FUND_NAME_PARTS = ["ETF", "BEES", "IETF", "LIQUID"]
FUND_SECTOR = "Equity"
HIGH_FREQUENCY_DESKS = [
    "GRAVITON", "IRAGE", "QE SECURITIES", "NK SECURITIES", "HRTI", "JUNOMONETA", "MUSIGMA",
    "MICROCURVES", "ALPHAGREP", "QUANT BROKING", "TOWER RESEARCH", "OPTIVER", "JANE STREET",
    "PROGRESSIVE", "SS CORPORATE SECUR", "AISHWARYA GLOBAL",
]
# indicator -> contiguous bars since the last gap before it is trusted
TRUSTED_AFTER_BARS = {
    "atr14": 7, "atr_pct": 7,
    "sma20": 20, "sma50": 50, "sma150": 150, "sma200": 200,
    "pct_from_52w_high": 20, "pct_from_52w_low": 20,
    "range_contraction_ratio": 20, "rel_volume": 20,
    "ret_20d": 21,
    "trend_template_pass": 220,
}
SCREENER_WEIGHTS = {
    "RT_RSI_85": 12, "RSI_IN_ALL_TF_ABOVE_65": 3, "RSI_IN_ALL_TF_65": 12,
    "RT_IPO_STOCKS_SCREENER": 12, "RT_HIGH_STRENGTH": 3, "PREMIUM_3_FOR_MOMENTUM": 11,
    "DARVAS": 11, "RT_52W_BREAKOUT": 10, "SNIPER_IN_PROCESS": 10, "RT_SIDEWAY_BREAKOUT": 8,
    "RT_52W_AWAY": 8, "PREMIUM_7.1": 8, "RT_RANGE_BREAKOUT_WITH_VOLUME": 7,
    "RT_DARVAS_BOX_BREAKOUT_STOCKS": 7, "RT_SNIPER_ENTRY_IN_PROCESS": 3, "RT_COP_IN_DAILY": 3,
    "RT_FOR_MAJOR_RETRACEMENT_MUTLIEYAR_RETEST_AREA": 3, "RT_READY_TO_REBOUND": 6,
    "RT_VCP_TURNAROUND": 7, "RT_15_20_AND_25_AWAY_FROM_52_WEEK_HIGHS": 6,
    "RT_MOMENTUM_MONSTERS": 6, "RT_STOCKS_AT_MAJOR_SUPPORT": 6,
    "RT_SIDEWAYS_BREAKOUT_AFTER_A_STRONG_UPTREND": 6, "RT_52_WEEK_BREAKOUT_SETUPS": 6,
    "RT_MASTER_RESISTANCE_BREAKOUT_SCREENER": 5, "RT_SHORT_TO_MID_SWING_RANGE_HIGH_BREAKOUT": 3,
    "RT_FIB_O.7_TO_0.88_ZONE": 3, "VCP": 2, "RT_DAILY_CONTRACTION": 2, "RT_IPO_SCREENER": 2,
    "RT_COP_STRATEGY": 0, "RT_MAJOR_SUPPORT": 0, "RT_FIB_0.7_TO_0.88_ZONE": 0,
    "RT_SHORT_TO_MID_RANGE_BREAKOUT": 0, "RT_MULTIYEAR_RETEST": 3, "RT_COP_DAILY": 0,
    "GEM_SWING": 3,
}
UNSEEN_SCREENER_WEIGHT = 3
BASE_KEYWORDS = ["AWAY", "SUPPORT", "CONTRACTION", "FIB", "REBOUND", "RETRACEMENT"]
BREAKOUT_KEYWORDS = [
    "BREAKOUT", "DARVAS", "52W", "52_WEEK", "RESISTANCE", "RANGE", "SIDEWAY", "SNIPER", "VCP",
    "HIGH_STRENGTH", "MOMENTUM_MONSTER",
]
MOMENTUM_KEYWORDS = ["RSI", "MOMENTUM", "PREMIUM", "EMA", "COP", "MULTIYEAR", "RETEST"]
RULE_PATTERNS = {
    "premium": r"(?i)Premium_7\.1",
    "breakout": r"(?i)BREAKOUT|RESISTANCE",
    "momentum": r"(?i)MOMENTUM",
    "volume": r"(?i)VOLUME",
    "support": r"(?i)SUPPORT",
    "fib": r"(?i)FIB",
    "contraction": r"(?i)CONTRACTION",
}
WYCKOFF_STRENGTH = [
    "RT_SIDEWAY_BREAKOUT", "RT_Range_Breakout_with_Volume",
    "RT_Master_Resistance_Breakout_Screener", "DARVAS", "RT_52W_BREAKOUT",
    "RT_SHORT_TO_MID_RANGE_BREAKOUT",
]
WYCKOFF_SUPPORT = ["RT_MAJOR_SUPPORT", "RT_Fib_0.7_to_0.88_Zone"]
WYCKOFF_BASE = ["RT_Daily_Contraction", "VCP"]
RECOMMENDATION_STOPWORDS = [
    "BUY", "SELL", "SL", "TGT", "TARGET", "CMP", "ABOVE", "BELOW", "HOLD", "EXIT",
    "BOOK", "PROFIT", "LOSS", "SHORT", "LONG", "CALL", "PUT", "ADD", "OK", "THE",
    "AND", "FOR", "NOW", "TODAY", "STOP", "ENTRY", "QTY", "LOT", "NIFTY", "BANK",
    "BANKNIFTY", "INDEX", "FUT", "CE", "PE", "NSE", "BSE", "ATH", "ATL", "DAY",
    "WEEK", "SWING", "POS", "INTRADAY", "BTST", "STBT", "GAP", "UP", "DOWN",
    "RS", "INR", "PER", "PVT", "LTD", "NEW", "OLD", "HIGH", "LOW", "OPEN", "CLOSE",
]
MENTION_STOPWORDS = [
    "BUY", "SELL", "SL", "TGT", "TARGET", "CMP", "ABOVE", "BELOW", "HOLD", "EXIT", "BOOK",
    "PROFIT", "LOSS", "SHORT", "LONG", "CALL", "PUT", "ADD", "OK", "THE", "AND", "FOR", "NOW",
    "TODAY", "STOP", "ENTRY", "QTY", "LOT", "NIFTY", "BANK", "INDEX", "FUT", "CE", "PE", "NSE",
    "BSE", "DAY", "WEEK", "SWING", "GAP", "UP", "DOWN", "INR", "NEW", "HIGH", "LOW", "OPEN",
    "CLOSE", "RSI",
]
COLUMN_ALIASES = {
    "Symbol": ["Symbol", "nsecode", "symbol"],
    "Stock Name": ["Stock Name", "name", "stockname"],
    "% Chg": ["% Chg", "%Chg", "%_change", "scan-column-default-percent-change"],
    "Price": ["Price", "close", "scan-column-default-close"],
    "Volume": ["Volume", "volume", "scan-column-default-volume"],
}
SETUP_PRESETS = {
    "": {},
    "sos": {"fresh": True, "vol": True, "noext": True, "nolag": True, "min_rs": 5.0, "tier_c": False},
    "lps": {"fresh": False, "vol": False, "noext": True, "nolag": True, "min_rs": 5.0, "tier_c": True},
    "ep": {"fresh": False, "vol": False, "noext": False, "nolag": True, "min_rs": 5.0, "tier_c": True},
}
LEDGER_COLUMNS = [
    "entry_date", "symbol", "name", "entry_price", "target", "target_pct", "stop", "stop_pct",
    "score", "rs", "tier", "persistent", "ep", "emerging", "fresh", "rw_admin", "status",
    "exit_date", "exit_price", "realized_pct", "peak_pct", "days_held", "last_price",
    "last_update",
]


@dataclass(frozen=True)
class Thresholds:
    """Every tunable number; pass a changed copy (``dataclasses.replace``) to override."""

    benchmark: str = "NIFTYBEES"
    max_gap_days: int = 5
    stale_after_days: int = 7
    year_bars: int = 252
    year_min_bars: int = 20
    max_abs_return: float = 100.0
    upside_pct: float = 20.0
    tp_pct: float = 25.0
    sl_pct: float = -5.0
    tradable_horizon: int = 30
    min_price: float = 20.0
    min_volume: float = 50_000.0
    min_score: float = 50.0
    shortlist_size: int = 25
    pattern_cap: int = 30
    momentum_cap: int = 10
    institutional_points: int = 10
    institutional_penalty: int = -8
    rs_cap: int = 35
    stop_atr_mult: float = 1.5
    stop_min_pct: float = 5.0
    stop_max_pct: float = 10.0
    reward_risk: float = 5.0
    target_min_pct: float = 15.0
    target_max_pct: float = 40.0
    stop_fallback_pct: float = 6.0
    target_fallback_pct: float = 30.0
    leader_rs: float = 15.0
    strip_days: int = 20
    persistent_days: int = 12
    new_leader_prior_days: int = 2
    pivot_gap_pct: float = 4.0
    pivot_rel_volume: float = 3.0
    emerging_max_rs: float = 25.0
    triage_rows: int = 60
    mention_window_days: int = 45
    time_stop_bars: int = 20
    alert_band: float = 0.03
    exit_cap_bars: int = 40
    exit_missing_atr: float = 0.05
    top_k: int = 10
    primary_sl: float = 8.0
    primary_horizon: int = 30
    weight_floor: float = 8.0
    weight_scale: float = 0.9
    weight_cap: int = 12
    weight_min_n: int = 120
    weight_drop_n: int = 30
    neutral_weight: int = 3


DEFAULTS = Thresholds()
