"""Triage view expressions: filters, sizing, markers and the score breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import SETUP_PRESETS
from .scoring import clamp, is_true


def has_call() -> Column:
    return is_true(F.col("mention_admin") > 0) | F.col("call_target").isNotNull() | \
        F.col("call_multiple").isNotNull() | F.col("call_tag").isNotNull()


def view_params(setup: str = "", **changes) -> dict:
    """Settings of a view: defaults, then the setup's preset, then explicit changes."""
    defaults = {
        "setup": setup, "persist": False, "newlead": False, "emerg": False, "mentioned": False,
        "admin": False, "tier_a": True, "tier_b": True, "tier_c": True, "fresh": False, "vol": False,
        "noext": False, "nolag": False, "not2t": False, "min_rs": None, "query": "", "sector": "",
        "dismissed": [], "show_dismissed": False, "sort_key": "rank", "descending": False,
    }
    return {**defaults, **SETUP_PRESETS[setup], **changes}


def view_filter(p: dict) -> Column:
    """Conjunction of the predicates that are switched on."""
    c = F.col
    tests = []

    def when_set(flag, test: Column) -> None:
        if flag:
            tests.append(is_true(test))

    when_set(p["setup"] == "sos", c("phase") == "SOS")
    when_set(p["setup"] == "lps", c("phase") == "LPS")
    when_set(p["setup"] == "ep", c("ep"))
    when_set(p["persist"], c("persistent"))
    when_set(p["newlead"], c("new_leader"))
    when_set(p["emerg"], c("emerging"))
    when_set(p["mentioned"], c("mentions") > 0)
    when_set(p["admin"], has_call())
    for letter in "ABC":
        when_set(not p[f"tier_{letter.lower()}"], c("tier") != letter)
    when_set(p["fresh"], c("fresh"))
    when_set(p["vol"], c("vol_ok"))
    when_set(p["noext"], ~c("extended"))
    when_set(p["nolag"], ~c("lagging"))
    when_set(p["not2t"], ~c("t2t"))
    when_set(p["min_rs"] is not None, c("rs") >= p["min_rs"])
    when_set(p["query"], F.lower("symbol").contains(p["query"]))
    when_set(p["sector"], c("sector") == p["sector"])
    when_set(p["dismissed"] and not p["show_dismissed"], ~c("symbol").isin(*p["dismissed"]))
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def view(triage: DataFrame, setup: str = "", **changes) -> DataFrame:
    """Filtered rows in the chosen order; a missing sort value sorts as the lowest."""
    p = view_params(setup, **changes)
    key = F.coalesce(F.col(p["sort_key"]), F.lit(-1e9))
    return triage.where(view_filter(p)).orderBy(key.desc() if p["descending"] else key.asc(), "symbol")


def shares_for(price: Column, stop: Column, capital: float, risk_pct: float) -> Column:
    """Shares risking ``risk_pct`` of ``capital`` at the stop; NULL when not sizable."""
    n = F.floor(F.try_divide(F.lit(capital * risk_pct / 100), price - stop))
    return F.when((stop < price) & (n > 0), n.cast("long"))


def target_state(price: Column, target: Column, multiple: Column, call_days: Column) -> Column:
    """struct(state, upside_pct) of a published target; implausible numbers give no state."""
    old = is_true(call_days > 180)
    plausible = is_true((target >= price * 0.4) & (target <= price * 15))
    state = (
        F.when(multiple.isNotNull(), F.when(old, "old multiple").otherwise("multiple"))
        .when(plausible, F.when(old, "historical").when(target <= price, "reached").otherwise("live")))
    upside = F.when(state == "live", F.round((target / price - 1) * 100, 0))
    return F.struct(state.alias("state"), upside.alias("upside_pct"))


def mention_marker(mentions: Column, call: Column, tag: Column, days: Column, call_days: Column) -> Column:
    """struct(css, mark): conviction call, any call, fresh buzz, recent, stale or none."""
    buzz = is_true(days <= 3)
    conviction = tag.isNotNull() & is_true(call_days <= 120)
    none = (F.coalesce(mentions, F.lit(0)) == 0) & ~call
    css = (F.when(none, "none").when(conviction, "recent").when(call, "mid").when(buzz, "recent")
           .when(is_true(days <= 14), "mid").otherwise("stale"))
    mark = F.when(none, "-").when(conviction, "*").when(call, "^").when(buzz, "*").otherwise("")
    return F.struct(css.alias("css"), mark.alias("mark"))


def score_breakdown(rs: Column, patterns: Column, fresh: Column, new_leader: Column, vol_ok: Column, inst: Column) -> Column:
    """array(struct(label, points, pct)): indicative make-up of a score."""
    def points(flag: Column, n: int) -> Column:
        return F.when(is_true(flag), n).otherwise(0)

    parts = [
        ("RS", clamp(F.coalesce(rs, F.lit(0.0)), 0.0, 35.0)),
        ("Patterns", F.least(F.size(patterns) * 8 + points(fresh, 6), F.lit(30))),
        ("Freshness", F.when(is_true(fresh), 15).otherwise(points(new_leader, 6))),
        ("Volume", points(vol_ok, 10)),
        ("Big-player", points(inst, 10)),
    ]
    total = F.lit(0.0)
    for _, p in parts:
        total = total + p
    total = F.when(total == 0, 1.0).otherwise(total)
    return F.array(*[
        F.struct(F.lit(label).alias("label"), p.cast("double").alias("points"), (p / total * 100).alias("pct"))
        for label, p in parts])


def public_columns(df: DataFrame) -> DataFrame:
    """Drop every private field: call and mention columns, and the ledger."""
    private = [c for c in df.columns if c.startswith(("mention", "call_", "rw")) or c == "ledger"]
    return df.drop(*private)


def public_meta(meta: DataFrame) -> DataFrame:
    """Meta row without ledger details and with the mention counters reset."""
    reset = {"has_group_data": F.lit(False), "mention_count": F.lit(0).cast("long"), "admin_count": F.lit(0).cast("long")}
    return meta.drop("ledger", "ledger_open", "alerts").withColumns(
        {c: v for c, v in reset.items() if c in meta.columns})
