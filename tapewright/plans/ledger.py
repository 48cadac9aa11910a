"""Paper-trade ledger: add picks, walk later bars to an outcome, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import is_true
from ..operators.asof import bars_before_map
from ..settings import DEFAULTS, LEDGER_COLUMNS, Thresholds

CLOSED = ["TARGET", "STOPPED", "EXPIRED"]
LENSES = ["persistent", "ep", "emerging", "fresh", "rw_admin"]
LENSES_SHORT = ["persistent", "ep", "emerging"]


def picks_from_triage(triage: DataFrame, sheet_date, top: int = 20) -> DataFrame:
    """OPEN ledger rows for the first ``top`` triage rows that carry all three levels."""
    c = F.col
    rows = triage.where(c("rank") <= top).where((c("price") > 0) & (c("target") > 0) & (c("stop") > 0))
    flag = lambda name: F.coalesce(c(name), F.lit(False)).alias(name)
    return rows.select(
        F.lit(sheet_date).cast("date").alias("entry_date"), "symbol", c("name"), c("price").alias("entry_price"),
        "target", F.coalesce("target_pct", F.lit(0.0)).alias("target_pct"),
        "stop", F.coalesce("stop_pct", F.lit(0.0)).alias("stop_pct"), "score", "rs", "tier",
        flag("persistent"), flag("ep"), flag("emerging"), flag("fresh"), flag("rw_admin"),
        F.lit("OPEN").alias("status"), F.lit(None).cast("date").alias("exit_date"),
        F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("double").alias("realized_pct"),
        F.lit(0.0).alias("peak_pct"), F.lit(0).alias("days_held"), c("price").alias("last_price"),
        F.lit(None).cast("date").alias("last_update"),
    ).select(*LEDGER_COLUMNS)


def add_picks(ledger: DataFrame, picks: DataFrame) -> DataFrame:
    """Append picks whose symbol has no OPEN position."""
    held = ledger.where(F.col("status") == "OPEN").select("symbol").distinct()
    return ledger.unionByName(picks.join(held, "symbol", "left_anti"), allowMissingColumns=True)


def walk(bars: Column, entry: Column, target: Column, stop: Column, peak0: Column, t: Thresholds = DEFAULTS) -> Column:
    """Outcome struct of one position from its next bars (an ordered array, at most 20).

    A bar touching both levels counts as stopped; the peak only looks at bars up to the
    exit; the last bar allowed closes the trade at its close.
    """
    hit_stop = lambda b: is_true(b["low"] <= stop)
    hit_target = lambda b: is_true(b["high"] >= target)
    ends = F.transform(bars, lambda b: hit_stop(b) | hit_target(b) | (b["k"] >= t.time_stop_bars))
    at = F.array_position(ends, True).cast("int")
    seen = F.when(at > 0, F.slice(bars, F.lit(1), at)).otherwise(bars)
    last = F.try_element_at(bars, F.nullif(at, F.lit(0)))
    status = (
        F.when(last.isNull(), "OPEN").when(hit_stop(last), "STOPPED")
        .when(hit_target(last), "TARGET").otherwise("EXPIRED"))
    level = (F.when(last.isNull(), F.lit(None).cast("double")).when(hit_stop(last), stop)
             .when(hit_target(last), target).otherwise(last["close"]))
    closes = F.filter(F.transform(seen, lambda b: b["close"]), lambda c: c.isNotNull())
    highs = F.filter(F.transform(seen, lambda b: b["high"]), lambda h: h.isNotNull())
    top = F.greatest(peak0, (F.array_max(highs) / entry - 1) * 100)
    return F.struct(
        status.alias("status"), last["date"].alias("exit_date"), F.round(level, 2).alias("exit_price"),
        F.round((level / entry - 1) * 100, 1).alias("realized_pct"), F.round(top, 1).alias("peak_pct"),
        F.size(seen).alias("days_held"),
        F.coalesce(F.try_element_at(closes, F.nullif(F.size(closes), F.lit(0))), entry).alias("last_price"))


def resolve_positions(positions: DataFrame, bars: DataFrame, run_date=None, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Walk every OPEN position over the bars strictly after its entry.

    A position can use at most the next 20 bars of its symbol, so each one asks for those
    bar numbers by equality on (symbol, number).  No range join, and no symbol's full
    history meets its full list of positions.  Positions of one symbol and entry date ask
    once and share the bars.  ``positions`` is read several times: pass the stored ledger.
    """
    changed = ["status", "exit_date", "exit_price", "realized_pct", "peak_pct", "days_held", "last_price"]
    is_open = F.col("status") == "OPEN"
    open_, rest = positions.where(is_open), positions.where(~is_open)
    numbered = bars.select(
        "symbol", "date", "high", "low", "close",
        F.row_number().over(Window.partitionBy("symbol").orderBy("date")).alias("bar_no"))
    keyed = bars_before_map(open_, bars, "entry_date")
    asked = keyed.select(
        "symbol", "entry_date", "bars_before",
        F.explode(F.sequence(F.col("bars_before") + 1, F.col("bars_before") + t.time_stop_bars)).alias("bar_no"))
    got = asked.join(numbered.withColumn("bar_no", F.col("bar_no").cast("long")), ["symbol", "bar_no"])
    k = (F.col("bar_no") - F.col("bars_before")).cast("int")
    paths = got.groupBy("symbol", "entry_date").agg(
        F.array_sort(F.collect_list(F.struct(k.alias("k"), "date", "high", "low", "close"))).alias("_bars"))
    joined = open_.join(paths, ["symbol", "entry_date"], "left")
    done = joined.withColumn("_o", F.when(F.col("_bars").isNotNull(), walk(
        F.col("_bars"), F.col("entry_price"), F.col("target"), F.col("stop"),
        F.coalesce("peak_pct", F.lit(0.0)), t)))
    updated = done.withColumns({
        **{c: F.when(F.col("_o").isNotNull(), F.col(f"_o.{c}")).otherwise(
            F.col("entry_price") if c == "last_price" else F.lit(0) if c == "days_held" else F.col(c)) for c in changed},
        "last_update": F.lit(run_date).cast("date") if run_date is not None else F.current_date(),
    }).drop("_o", "_bars")
    return updated.unionByName(rest, allowMissingColumns=True)


# ---- reports ---------------------------------------------------------------------

def profit_factor(realized: Column) -> Column:
    """Gains over losses, a result of zero or less counting as loss; NULL without losses."""
    gains = F.sum(F.when(realized > 0, realized))
    losses = -F.sum(F.when(realized <= 0, realized))
    return F.when(losses != 0, F.coalesce(gains, F.lit(0.0)) / losses)


def ledger_report(ledger: DataFrame) -> DataFrame:
    """One row: counts by status, win rate, mean result, profit factor, open averages.

    The profit factor is infinite when nothing was lost (NULL in the compact summary).
    """
    closed, open_ = F.col("status").isin(*CLOSED), F.col("status") == "OPEN"
    realized = F.when(closed, F.col("realized_pct"))
    return ledger.agg(
        F.count(F.lit(1)).alias("picks"), F.count_if(open_).alias("open"), F.count_if(closed).alias("closed"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in CLOSED],
        (F.avg(F.when(closed, (F.col("status") == "TARGET").cast("double"))) * 100).alias("win_rate"),
        F.avg(realized).alias("avg_realized"),
        F.when(F.count_if(closed) > 0, F.coalesce(profit_factor(realized), F.lit(float("inf")))).alias("profit_factor"),
        F.avg(F.when(open_, (F.try_divide("last_price", "entry_price") - 1) * 100)).alias("open_unrealized"),
        F.avg(F.when(open_, F.col("peak_pct"))).alias("open_peak"))


def lens_report(ledger: DataFrame, lenses: list[str] | None = None) -> DataFrame:
    """Closed trades per lens, and those carrying none of the three chart lenses."""
    named = lenses or LENSES
    none = F.lit(True)
    for name in LENSES_SHORT:
        none = none & ~is_true(F.col(name))
    labels = F.array_compact(F.array(
        *[F.when(is_true(F.col(n)), n) for n in named], F.when(none, "(no lens)")))
    closed = ledger.where(F.col("status").isin(*CLOSED)).select("status", "realized_pct", F.explode(labels).alias("lens"))
    return closed.groupBy("lens").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("status") == "TARGET").cast("double")) * 100).alias("win_pct"),
        F.avg("realized_pct").alias("avg_realized"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Compact rounded report of the triage page, with the three chart lenses nested."""
    r = ledger_report(ledger)
    lens = lens_report(ledger, LENSES_SHORT).where(F.col("lens") != "(no lens)").agg(
        F.sort_array(F.collect_list(F.struct("lens", "n", F.bround("win_pct", 0).cast("int").alias("win")))).alias("l"))
    return r.select(
        F.col("picks").alias("total"), "open", "closed", F.bround("win_rate", 0).cast("int").alias("win_rate"),
        F.round("avg_realized", 2).alias("avg_realized"),
        F.when(F.col("profit_factor") != float("inf"), F.round("profit_factor", 2)).alias("profit_factor"),
        "target", "stopped", "expired", F.round("open_unrealized", 2).alias("open_unrealized"),
        lens.scalar().alias("lens"))


def unrealized() -> Column:
    return F.round((F.try_divide("last_price", "entry_price") - 1) * 100, 1)


def symbol_status(ledger: DataFrame) -> DataFrame:
    """Newest position of each symbol; of one date an open one, then the one updated, closed or targeted last."""
    info = F.struct("status", "entry_date", unrealized().alias("unreal"), F.col("peak_pct").alias("peak"),
                    F.coalesce("days_held", F.lit(0)).alias("days"), F.col("realized_pct").alias("realized"))
    return ledger.groupBy("symbol").agg(F.max_by(info, F.struct(
        "entry_date", F.col("status") == "OPEN", "exit_date", "target", "stop", "status")).alias("ledger"))


def open_positions(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "OPEN").select(
        "symbol", F.substring("name", 1, 40).alias("name"), "entry_date", "entry_price", "target", "stop",
        "last_price", unrealized().alias("unreal"), "peak_pct", "days_held", "persistent", "ep")


def ledger_alerts(ledger: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Positions resolved in the latest update, and open ones close to a level."""
    newest = ledger.agg(F.max("last_update")).scalar()
    last, tgt, stp = F.col("last_price"), F.col("target"), F.col("stop")
    near = F.when(is_true((tgt - last) / last <= t.alert_band), "near-target").when(
        is_true((last - stp) / last <= t.alert_band), "near-stop")
    kind = (
        F.when((F.col("status") == "OPEN") & is_true(last != 0) & tgt.isNotNull() & stp.isNotNull(), near)
        .when(F.col("status").isin(*CLOSED) & F.col("exit_date").isNotNull() & is_true(F.col("last_update") == newest),
              F.lower("status")))
    detail = (
        F.when(kind == "near-target", F.format_string("%+.1f%% held, ~%.0f%% to target", unrealized(), F.bround((tgt / last - 1) * 100, 0)))
        .when(kind == "near-stop", F.format_string("%+.1f%%, near stop", unrealized()))
        .otherwise(F.format_string("%+.1f%% on %s", F.col("realized_pct"), F.col("exit_date").cast("string"))))
    return ledger.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "symbol", "entry_date", "kind", detail.alias("detail"))
