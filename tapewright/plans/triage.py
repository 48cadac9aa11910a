"""Triage rows of a day: candidates with leadership history, phases, tiers and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.scoring import is_true
from ..functions.views import has_call
from ..operators.asof import session_calendar
from ..settings import DEFAULTS, Thresholds


def recent_sessions(bars: DataFrame, as_of, n: int) -> DataFrame:
    """(date, slot): the last ``n`` market dates up to ``as_of``, slot 1 being the oldest."""
    day = F.lit(as_of).cast("date")
    dates = bars.where(F.col("date") <= day).select("date").distinct().orderBy(F.col("date").desc()).limit(n)
    listed = dates.agg(F.array_sort(F.collect_list("date")).alias("d"))
    return listed.select(F.posexplode("d").alias("_i", "date"), F.size("d").alias("slots")).select(
        "date", (F.col("_i") + 1).alias("slot"), "slots")


def leadership(indicators: DataFrame, as_of, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Per symbol: 20-session strip, leader counts, pivot and emerging flags, sparkline.

    Only the last 20 market dates are read (20 joined rows), so a symbol gathers at
    most 20 small structs.
    """
    cols = ["open", "high", "low", "close", "rel_volume"]
    recent = indicators.join(recent_sessions(indicators, as_of, t.strip_days), "date")
    per = recent.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("slot", *cols, F.col("rs_vs_market").alias("rs")))).alias("r"),
        F.max("slots").alias("slots"))
    slots = F.sequence(F.lit(1), F.col("slots"))

    def at(slot: Column) -> Column:
        return F.try_element_at(F.filter("r", lambda x: x["slot"] == slot), F.lit(1))

    per = per.withColumn("_rs", F.transform(slots, lambda s: at(s)["rs"]))
    strip = F.transform("_rs", lambda v: F.when(v >= t.leader_rs, 2).when(v.isNotNull(), 1).otherwise(0))
    per = per.withColumn("strip", strip)
    flipped = F.reverse(F.transform("strip", lambda x: x != 2))
    first_break = F.array_position(flipped, True).cast("int")
    n = F.col("slots")
    per = per.withColumns({
        "leader_days": F.size(F.filter("strip", lambda x: x == 2)),
        "streak": F.when(first_break == 0, n).otherwise(first_break - 1),
        "_today": at(n),
        "_prev": F.try_element_at(F.filter("r", lambda x: x["slot"] < n), F.lit(-1)),
        "_rs_now": F.element_at("_rs", -1),
        "_rs_then": F.when(n >= 6, F.try_element_at("_rs", F.lit(-6))).otherwise(F.element_at("_rs", 1)),
    })
    now, prev = F.col("_today"), F.col("_prev")
    prior = F.col("leader_days") - (F.element_at("strip", -1) == 2).cast("int")
    per = per.withColumns({
        "persistent": F.col("leader_days") >= t.persistent_days,
        "new_leader": (F.element_at("strip", -1) == 2) & (prior <= t.new_leader_prior_days),
        "gap": F.when(prev["close"] > 0, (now["open"] / prev["close"] - 1) * 100),
        "rel_vol": now["rel_volume"],
        "close_pos": F.when(now["high"] > now["low"], (now["close"] - now["low"]) / (now["high"] - now["low"])),
    })
    raw = is_true(F.col("gap") >= t.pivot_gap_pct) & is_true(F.col("rel_vol") >= t.pivot_rel_volume)
    held = is_true(F.col("close_pos") >= 0.5)
    rs_now, rs_then = F.col("_rs_now"), F.col("_rs_then")
    closes = F.filter(F.transform("r", lambda x: F.round(x["close"], 2)), lambda c: c.isNotNull())
    return per.withColumns({
        "ep": raw & (held | F.col("close_pos").isNull()),
        "ep_fade": raw & F.col("close_pos").isNotNull() & ~held,
        "emerging": is_true(F.col("rel_vol") >= t.pivot_rel_volume)
        & is_true((rs_now > 0) & (rs_now <= t.emerging_max_rs) & (rs_now > rs_then)),
        "spark": closes,
    }).select("symbol", "strip", "leader_days", "streak", "persistent", "new_leader", "gap", "rel_vol",
              "close_pos", "ep", "ep_fade", "emerging", "spark")


def leadership_history(indicators: DataFrame, *, bars: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """(symbol, date, leader_days, persistent, new_leader, emerging) on every date.

    Market dates are numbered, so "the last 20 sessions" is a range frame over the number
    and a symbol's absent days simply do not count.  The dates come from ``bars``, the rows
    that the indicators were made of, where given: then the indicators run once.
    """
    cal = session_calendar(indicators if bars is None else bars).select("date", "session")
    lead = is_true(F.col("rs_vs_market") >= t.leader_rs).cast("int")
    w = Window.partitionBy("symbol").orderBy("session")
    back = w.rangeBetween(-(t.strip_days - 1), 0)
    five_ago = F.max("rs_vs_market").over(w.rangeBetween(-5, -5))
    df = indicators.join(cal, "date").withColumn("_lead", lead)
    df = df.withColumns({"leader_days": F.sum("_lead").over(back).cast("int"), "_then": five_ago})
    rs = F.col("rs_vs_market")
    return df.select(
        "symbol", "date", "leader_days",
        (F.col("leader_days") >= t.persistent_days).alias("persistent"),
        ((F.col("_lead") == 1) & (F.col("leader_days") - 1 <= t.new_leader_prior_days)).alias("new_leader"),
        (is_true(F.col("rel_volume") >= t.pivot_rel_volume)
         & is_true((rs > 0) & (rs <= t.emerging_max_rs) & (rs > F.col("_then")))).alias("emerging"))


def sheet_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every symbol of either side: new, dropped or kept, with rank and score changes."""
    cur = current.select("symbol", F.col("rank").alias("rank_now"), F.col("score").alias("score_now"))
    prev = previous.select("symbol", F.col("rank").alias("rank_before"), F.col("score").alias("score_before"))
    both = cur.join(prev, "symbol", "full_outer")
    state = F.when(F.col("rank_before").isNull(), "new").when(F.col("rank_now").isNull(), "dropped").otherwise("kept")
    return both.select(
        "symbol", state.alias("state"), "rank_now", "rank_before", "score_now", "score_before",
        (F.col("rank_before") - F.col("rank_now")).alias("rank_delta"),
        (F.col("score_now") - F.col("score_before")).alias("score_delta"))


def diff_report(diff: DataFrame) -> DataFrame:
    """The page's change list: dropped by previous rank (20) and biggest movers (12)."""
    dropped = diff.where(F.col("state") == "dropped").orderBy("rank_before", "symbol").limit(20)
    movers = diff.where((F.col("state") == "kept") & (F.col("score_delta") != 0)).orderBy(
        F.abs("score_delta").desc(), "rank_now").limit(12)
    cols = ["symbol", "rank_now", "rank_before", "score_now", "score_before", "rank_delta", "score_delta"]
    return dropped.select(F.lit("dropped").alias("list"), *cols).unionByName(
        movers.select(F.lit("mover").alias("list"), *cols))


def triage_rows(candidates: DataFrame, *, leaders: DataFrame | None = None, series: DataFrame | None = None,
                mentions: DataFrame | None = None, previous: DataFrame | None = None,
                ledger: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """The day's first 60 candidates with everything the triage page shows."""
    c = F.col
    df = candidates.where(c("rank") <= t.triage_rows)
    df = df.join(series, "symbol", "left") if series is not None else df.withColumn("series", F.lit(None).cast("string"))
    flags = S.triage_flags(c("new_screeners"), c("chg"), c("rs_vs_market"), c("volume_pct"), c("buy_qty"), c("sell_qty"), c("series"), t)
    checks = S.check_count(flags)
    df = df.withColumns({
        **flags, "checks": checks, "tier": S.tier(flags, checks),
        "phase": S.wyckoff_phase(c("new_screeners"), c("screeners"), flags["vol_ok"], c("chg"), c("rs_vs_market")),
    })
    if leaders is not None:
        df = df.join(leaders, "symbol", "left")
        df = df.fillna(False, ["persistent", "new_leader", "ep", "ep_fade", "emerging"]).fillna(0, ["leader_days", "streak"])
    if mentions is not None:
        df = df.join(mentions.select(
            "symbol", "mentions", F.col("admin_mentions").alias("mention_admin"), F.col("days_since").alias("mention_days"),
            F.col("target").alias("call_target"), F.col("target_multiple").alias("call_multiple"),
            F.col("tag").alias("call_tag"), "call_days"), "symbol", "left").fillna(0, ["mentions", "mention_admin"])
    if previous is not None:
        df = df.join(previous.select(
            "symbol", F.col("rank").alias("_pr"), F.col("score").alias("_ps")), "symbol", "left")
        # Without any previous sheet nothing counts as new.
        known = previous.agg((F.count(F.lit(1)) > 0).alias("k")).scalar()
        df = df.withColumns({
            "is_new": c("_pr").isNull() & known, "rank_delta": c("_pr") - c("rank"), "score_delta": c("score") - c("_ps"),
        }).drop("_pr", "_ps")
    if ledger is not None:
        df = df.join(ledger, "symbol", "left")
    name = F.col("stock_name") if "stock_name" in df.columns else F.col("symbol")
    return df.withColumns({
        "rs": F.round("rs_vs_market", 1), "name": F.substring(name, 1, 44),
        "target": F.round("target_price", 2), "stop": F.round("stop_price", 2),
        "rw_admin": has_call() if mentions is not None else F.lit(False),
    })


def triage_meta(rows: DataFrame, total_gated: DataFrame) -> DataFrame:
    """One row of page counters; ``total_gated`` is a one-cell frame."""
    def count(flag: Column) -> Column:
        return F.count_if(is_true(flag))

    top10 = F.when(F.col("rank") <= 10, F.col("rs"))
    return rows.agg(
        F.count(F.lit(1)).alias("shown"),
        count(F.col("tier") == "A").alias("tier_a"), count(F.col("tier") == "B").alias("tier_b"),
        count(F.col("fresh")).alias("fresh_count"), F.median(top10).alias("median_rs_top10"),
        count(F.col("persistent")).alias("persistent_count"), count(F.col("new_leader")).alias("new_leader_count"),
        count(F.col("ep")).alias("ep_count"), count(F.col("emerging")).alias("emerging_count"),
        count(F.col("mentions") > 0).alias("mention_count"), count(has_call()).alias("admin_count"),
        (count(F.col("mentions") > 0) > 0).alias("has_group_data"), count(F.col("is_new")).alias("new_count"),
    ).withColumn("total_gated", total_gated.scalar())


def strength_ladder(rows: DataFrame, k: int = 10) -> DataFrame:
    """Top ten by score, then only those with a known relative strength."""
    return rows.orderBy(F.col("score").desc(), "symbol").limit(k).where(F.col("rs").isNotNull())
