"""Setup-score components, levels, phases and tiers as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    DEFAULTS,
    FUND_NAME_PARTS,
    FUND_SECTOR,
    RULE_PATTERNS,
    TRADE_TO_TRADE_SERIES,
    WYCKOFF_BASE,
    WYCKOFF_STRENGTH,
    WYCKOFF_SUPPORT,
    Thresholds,
)
from .screeners import categorize_screener, names_in, normalize_screener, tag_screeners


def is_true(c: Column) -> Column:
    """Comparison result with unknown read as false."""
    return F.coalesce(c, F.lit(False))


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _unless_null(c: Column, points: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(points)


def is_fund(symbol: Column, sector: Column) -> Column:
    named = symbol.rlike("(?i)" + "|".join(FUND_NAME_PARTS))
    return is_true(named) | is_true(sector == FUND_SECTOR)


def liquidity_gate(symbol: Column, price: Column, volume: Column, sector: Column,
                   *, require_sector: bool, t: Thresholds = DEFAULTS) -> Column:
    """Price and volume floor without funds; the live variant also requires a sector."""
    ok = (
        (F.coalesce(price, F.lit(0.0)) >= t.min_price)
        & (F.coalesce(volume.cast("double"), F.lit(0.0)) >= t.min_volume)
        & ~is_fund(symbol, sector)
    )
    return ok & sector.isNotNull() if require_sector else ok


def fresh_triggers(fresh: Column) -> Column:
    """The fresh names that are breakout or momentum screeners."""
    return names_in(tag_screeners(fresh), "breakout", "momentum")


def confluence_score(count: Column, diff: Column, triggers: Column, cap: int | None = None) -> Column:
    """Breadth of hits today, its change and fresh triggers; ``cap`` is off by default."""
    breadth = _unless_null(count, F.least(count.cast("int") * 2, F.lit(10)))
    change = F.when(diff > 0, 5).when(diff < 0, -3).otherwise(0)
    trigger = F.when(F.size(triggers) > 0, 5).otherwise(0)
    score = F.greatest(breadth + change + trigger, F.lit(0))
    return score if cap is None else F.least(score, F.lit(cap))


def momentum_volume_score(chg: Column, volume_pct: Column, t: Thresholds = DEFAULTS) -> Column:
    move = (
        F.when((chg >= 1) & (chg <= 8), 7)
        .when((chg > 8) & (chg <= 15), 4)
        .when(chg > 15, 1)
        .otherwise(0)
    )
    volume = _unless_null(volume_pct, F.bround(volume_pct * 8, 0).cast("int"))
    return F.least(move + volume, F.lit(t.momentum_cap))


def institutional_score(buy: Column, sell: Column, t: Thresholds = DEFAULTS) -> Column:
    """Needs both sides: a one-sided quantity compares as unknown and scores 0."""
    return (
        F.when(buy > sell, t.institutional_points)
        .when(sell > buy, t.institutional_penalty)
        .otherwise(0)
    )


def relative_strength_score(rs: Column, t: Thresholds = DEFAULTS) -> Column:
    return _unless_null(rs, F.floor(clamp(rs, 0.0, float(t.rs_cap))).cast("int"))


def total_score(*parts: Column) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return clamp(total, 0, 100)


def setup_type(breakout: Column, momentum: Column, base: Column) -> Column:
    return (
        F.when(F.size(breakout) > 0, "Breakout / Momentum")
        .when((F.size(momentum) > 0) & (F.size(base) == 0), "Momentum continuation")
        .when(F.size(base) > 0, "Base / Support (early-stage, needs confirmation)")
        .otherwise("Mixed / weak signal")
    )


def risk_levels(entry: Column, atr_pct: Column, t: Thresholds = DEFAULTS) -> Column:
    """Volatility-sized stop and target; NULL without a positive entry price."""
    sized = is_true(atr_pct > 0)
    stop = F.when(sized, clamp(atr_pct * t.stop_atr_mult, t.stop_min_pct, t.stop_max_pct)).otherwise(
        F.lit(t.stop_fallback_pct))
    scaled = clamp(stop * t.reward_risk, t.target_min_pct, t.target_max_pct)
    target = F.when(sized, scaled).otherwise(F.lit(t.target_fallback_pct))
    return F.when(
        entry > 0,
        F.struct(
            stop.alias("stop_pct"),
            target.alias("target_pct"),
            (entry * (1 - stop / 100)).alias("stop_price"),
            (entry * (1 + target / 100)).alias("target_price"),
            (target / stop).alias("rr"),
            F.when(sized, "ATR").otherwise("flat").alias("basis"),
        ),
    )


def pct_move(base: Column, now: Column) -> Column:
    """Percent move from ``base``; NULL on a missing or zero base."""
    return (F.try_divide(now, base) - 1) * 100


# ---- explanation text -------------------------------------------------------

def confluence_note(diff: Column, triggers: Column) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(diff > 0, "strengthening (+screeners vs yesterday)")
        .when(diff < 0, "weakening (-screeners vs yesterday)"),
        F.when(F.size(triggers) > 0,
               F.concat(F.lit("fresh trigger today: "), F.array_join(triggers, ", "))),
    )
    return F.nullif(parts, F.lit(""))


def momentum_note(chg: Column, volume_pct: Column) -> Column:
    def signed(template: str) -> Column:
        return F.format_string(template, chg)

    move = (
        F.when((chg >= 1) & (chg <= 8), signed("healthy move today (%+.1f%%)"))
        .when((chg > 8) & (chg <= 15), signed("strong move, some chase risk (%+.1f%%)"))
        .when(chg > 15, signed("CAUTION extended (%+.1f%%)"))
        .when(chg < 0, signed("down today (%+.1f%%)"))
    )
    volume = F.when(volume_pct >= 0.9, "top-decile volume today").when(
        volume_pct >= 0.75, "elevated volume today")
    return F.nullif(F.concat_ws("; ", move, volume), F.lit(""))


def institutional_note(buy: Column, sell: Column) -> Column:
    b, s = F.format_number(buy, 0), F.format_number(sell, 0)
    return F.when(
        buy > sell, F.concat(F.lit("bulk/block BUY > SELL ("), b, F.lit(" vs "), s, F.lit(")"))
    ).when(
        sell > buy,
        F.concat(F.lit("CAUTION bulk/block SELL > BUY ("), s, F.lit(" vs "), b, F.lit(")")),
    )


def relative_strength_note(rs: Column) -> Column:
    return (
        F.when(rs >= 15, F.format_string("strong relative strength vs. market (+%.1fpp/20d)", rs))
        .when(rs >= 5, F.format_string("outperforming market (+%.1fpp/20d)", rs))
        .when(rs < 0, F.format_string("CAUTION lagging market (%+.1fpp/20d)", rs))
    )


def reasoning(breakout: Column, momentum: Column, *notes: Column) -> Column:
    listed = F.array_join(F.concat(breakout, momentum), ", ")
    lead = F.concat(F.lit("patterns: "), F.when(listed == "", "none").otherwise(listed))
    return F.concat_ws("; ", lead, *notes)


# ---- phases and tiers --------------------------------------------------------

def rule_phase(screener_text: Column, diff: Column) -> Column:
    text = F.coalesce(screener_text, F.lit(""))
    hit = {name: text.rlike(pattern) for name, pattern in RULE_PATTERNS.items()}
    rebound = hit["premium"] & (hit["support"] | hit["fib"] | hit["contraction"]) & ~hit["breakout"]
    moving = hit["breakout"] | hit["momentum"]
    trigger = hit["premium"] & moving & (F.coalesce(diff, F.lit(0)) >= 3)
    return (
        F.when(rebound, "Rebound Setup")
        .when(trigger, "Breakout Trigger")
        .when(moving, "Momentum Continuation")
        .otherwise("Neutral")
    )


def _any_of(screeners: Column, names: list[str], ignore_case: bool) -> Column:
    if ignore_case:
        screeners = F.transform(screeners, normalize_screener)
        names = [n.upper() for n in names]
    return is_true(F.arrays_overlap(screeners, F.array(*[F.lit(n) for n in names])))


def wyckoff_phase(fresh: Column, screeners: Column, volume_ok: Column, chg: Column, rs: Column,
                  *, ignore_case: bool = False) -> Column:
    """'SOS', 'LPS', 'Base' or ''.  Names are compared as written unless ``ignore_case``."""
    firing = _any_of(fresh, WYCKOFF_STRENGTH, ignore_case)
    at_support = _any_of(screeners, WYCKOFF_SUPPORT, ignore_case)
    contracting = _any_of(screeners, WYCKOFF_BASE, ignore_case)
    calm = ~is_true(chg > 15)
    leading = is_true(rs >= 5)
    return (
        F.when(firing & volume_ok & calm & leading, "SOS")
        .when(at_support & ~firing & calm & leading & is_true((chg >= -4) & (chg <= 3)), "LPS")
        .when(contracting & ~firing, "Base")
        .otherwise("")
    )


def triage_flags(fresh: Column, chg: Column, rs: Column, volume_pct: Column, buy: Column,
                 sell: Column, series: Column, t: Thresholds = DEFAULTS) -> dict[str, Column]:
    """The yes/no facts behind the tier, from columns rather than from the note text."""
    return {
        "rs_strong": is_true(rs >= t.leader_rs),
        "fresh": is_true(F.exists(
            fresh, lambda s: categorize_screener(normalize_screener(s)) == "breakout")),
        "vol_ok": is_true(volume_pct >= 0.75),
        "inst": is_true(buy > sell),
        "healthy": is_true((chg >= 1) & (chg <= 8)),
        "extended": is_true(chg > 15),
        "lagging": is_true(rs < 0),
        "t2t": is_true(series.isin(*TRADE_TO_TRADE_SERIES)),
    }


def check_count(f: dict[str, Column]) -> Column:
    """How many of the six checks pass."""
    passed = [f["rs_strong"], f["fresh"], f["vol_ok"], f["healthy"] & ~f["extended"],
              ~f["lagging"], ~f["t2t"]]
    total = F.lit(0)
    for p in passed:
        total = total + p.cast("int")
    return total


def tier(f: dict[str, Column], checks: Column) -> Column:
    return (
        F.when((checks >= 5) & f["rs_strong"] & f["fresh"], "A")
        .when(checks >= 3, "B")
        .otherwise("C")
    )
