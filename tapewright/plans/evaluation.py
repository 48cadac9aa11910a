"""Evaluation of a labeled history: precision at k, deciles, splits, trade grids.

Frames are reduced to the needed columns and pre-aggregated before any shuffle by
date; what is broadcast has at most one row per calendar date (times a constant).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import add_deciles, top_k
from ..operators.timeseries import add_segments, forward_returns, with_picks
from ..session import cut_lineage
from ..settings import (
    COMBO_HORIZON_GRID,
    COMBO_SL_GRID,
    COMBO_TP_GRID,
    DEFAULTS,
    HORIZON_GRID,
    HORIZONS,
    SL_GRID,
    TP_GRID,
    Thresholds,
)


def best_first(score: str = "score") -> list[Column]:
    """Score descending, ties by symbol."""
    return [F.col(score).desc(), F.col("symbol").asc()]


def by_horizon(panel: DataFrame, *keep: str) -> DataFrame:
    """One narrow row per (row, horizon): keep, horizon_days, touched, future_max."""
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"upside_touched_{h}d").alias("touched"),
                 F.col(f"future_max_{h}d").alias("future_max")) for h in HORIZONS])
    return panel.select(*keep, F.inline(cells)).where(F.col("touched").isNotNull())


def _horizon_sums() -> list[Column]:
    out = []
    for h in HORIZONS:
        known = F.col(f"upside_touched_{h}d").isNotNull()
        out += [F.count_if(known).alias(f"n_{h}"),
                F.sum(f"upside_touched_{h}d").alias(f"w_{h}"),
                F.sum(F.when(known, F.col(f"future_max_{h}d"))).alias(f"f_{h}")]
    return out


def _unfold_horizons(sums: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Totals per key and horizon into counts and means."""
    total = sums.groupBy(*keys).agg(*[
        F.sum(f"{p}_{h}").alias(f"{p}_{h}") for h in HORIZONS for p in ("n", "w", "f")])
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"n_{h}").alias(n),
                 F.try_divide(f"w_{h}", f"n_{h}").alias("win_rate"),
                 F.try_divide(f"f_{h}", f"n_{h}").alias("avg_future_max")) for h in HORIZONS])
    return total.select(*keys, F.inline(cells)).where(F.col(n) > 0)


def decile_table(panel: DataFrame, score: str = "score") -> DataFrame:
    """Win rate and mean peak per score decile and horizon.

    Rows are first summed per (date, score), whatever the score's domain, and written once;
    the deciles are assigned to those.
    """
    cells = panel.where(F.col(score).isNotNull()).groupBy("date", score).agg(
        F.count(F.lit(1)).alias("rows"), *_horizon_sums())
    deciled = add_deciles(cut_lineage(cells, "decile-cells"), ["date"], score, "rows")
    return _unfold_horizons(deciled, ["decile"], "n").orderBy("horizon_days", F.col("decile").desc())


def precision_by_day(panel: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Per date and horizon: hit rate of the top k against that of all rows."""
    long = by_horizon(panel.where(F.col(score).isNotNull()), "date", "symbol", score)
    top = top_k(long, ["date", "horizon_days"], best_first(score), k).groupBy("date", "horizon_days").agg(
        F.avg("touched").alias("precision_at_k"), F.count(F.lit(1)).alias("n_top"))
    base = panel.where(F.col(score).isNotNull()).groupBy("date").agg(*_horizon_sums())
    base = _unfold_horizons(base, ["date"], "n").select(
        "date", "horizon_days", F.col("win_rate").alias("baseline_win_rate"))
    return top.join(base, ["date", "horizon_days"]).withColumn("k", F.lit(k))


def precision_summary(per_day: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return per_day.groupBy(*keys, "horizon_days").agg(
        F.avg("precision_at_k").alias("avg_precision_at_k"),
        F.avg("baseline_win_rate").alias("avg_baseline_win_rate"),
        F.count(F.lit(1)).alias("n_days"),
    ).withColumn("lift", F.try_divide("avg_precision_at_k", "avg_baseline_win_rate"))


def precision_at_k(panel: DataFrame, k: int, score: str = "score") -> DataFrame:
    return precision_summary(precision_by_day(panel, k, score))


def precision_at_k_tradable(panel: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Per date: share of wins in the top k and among all decided rows."""
    known = panel.where(F.col(score).isNotNull() & F.col("tradable_win").isNotNull()).select(
        "date", "symbol", score, "tradable_win")
    top = top_k(known, ["date"], best_first(score), k).groupBy("date").agg(
        F.avg("tradable_win").alias("precision_at_k"), F.count(F.lit(1)).alias("n_top"))
    base = known.groupBy("date").agg(F.avg("tradable_win").alias("baseline_win_rate"))
    return top.join(base, "date").withColumn("k", F.lit(k))


def cutoff_date(panel: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: the date at ``share`` of the ordered distinct dates (a calendar-sized list)."""
    dates = panel.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("d"))
    return dates.select(F.element_at("d", F.floor(F.size("d") * share).cast("int") + 1).alias("cutoff"))


def split_precision(panel: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """Precision summaries before and after the 70 % date."""
    cut = cutoff_date(panel).scalar()
    per_day = precision_by_day(panel, k, score).withColumn(
        "split", F.when(F.col("date") <= cut, "in_sample").otherwise("out_of_sample"))
    return precision_summary(per_day, ["split"])


def rule_phase_table(panel: DataFrame) -> DataFrame:
    sums = panel.groupBy("rule_phase").agg(*_horizon_sums())
    return _unfold_horizons(sums, ["rule_phase"], "samples").orderBy("horizon_days", F.col("win_rate").desc())


def sector_table(panel: DataFrame, horizon: int = 15, top_n: int = 25, score: str = "score") -> DataFrame:
    touched = F.col(f"upside_touched_{horizon}d")
    rows = panel.where(F.col(score).isNotNull() & touched.isNotNull()).select(
        "date", "symbol", "sector", "price", score, touched.alias("touched"))
    return (
        top_k(rows, ["date"], best_first(score), top_n).where(F.col("sector").isNotNull())
        .groupBy("sector").agg(F.count("touched").alias("n"), F.avg("touched").alias("win_rate"),
                               F.avg("price").alias("avg_price"))
        .orderBy(F.col("n").desc())
    )


# ---- trade grids -------------------------------------------------------------

def daily_picks(panel: DataFrame, k: int, score: str = "score", name: str | None = None) -> DataFrame:
    rows = panel.where(F.col(score).isNotNull()).select("date", "symbol", score)
    return top_k(rows, ["date"], best_first(score), k, name)


def pick_paths(picks: DataFrame, panel: DataFrame, *, price: str = "price", t: Thresholds = DEFAULTS) -> DataFrame:
    """Forward paths of the picks; the panel is read as (symbol, date, price) only.

    ``picks`` holds each (symbol, date) at most once.  Paths are built for picks only, inside
    the symbol window: no array is shuffled.
    """
    narrow = with_picks(panel.select("symbol", "date", F.col(price).alias("close")), picks)
    paths = forward_returns(add_segments(narrow, t=t), max(HORIZON_GRID), max_abs=t.max_abs_return)
    others = [F.col(f"picked.{c}") for c in picks.columns if c not in ("symbol", "date")]
    return paths.where(F.col("picked").isNotNull()).select("symbol", "date", *others, "path")


Cell = tuple[float, float, int]


def grid_outcomes(paths: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """One row per (pick, cell): tp, sl, h, ret, hold, outcome.

    Each distinct level is looked up in the path once; a cell then only compares two bar
    numbers.  The fixed grid is unfolded next to each pick, without a join.
    """
    tps, sls, bars = (sorted({c[i] for c in cells}) for i in range(3))
    path = F.col("path")

    def first_at(levels, hit) -> Column:
        """Bar of the first hit per level, 0 when there is none."""
        listed = F.array(*[F.lit(float(x)) for x in levels])
        return F.transform(listed, lambda x: F.array_position(F.transform(path, lambda r: hit(r, x)), True).cast("int"))

    marks = F.array(*[F.element_at(path, F.least(F.lit(h), F.size(path))) for h in bars])
    grid = F.array(*[
        F.struct(F.lit(float(tp)).alias("tp"), F.lit(float(sl)).alias("sl"), F.lit(int(h)).alias("h"),
                 F.lit(tps.index(tp) + 1).alias("i"), F.lit(sls.index(sl) + 1).alias("j"), F.lit(bars.index(h) + 1).alias("m"))
        for tp, sl, h in cells])
    found = paths.where(F.size(path) > 0).select(
        "symbol", "date", F.size(path).alias("seen"), marks.alias("marks"),
        first_at(tps, lambda r, x: r >= x).alias("win_at"), first_at(sls, lambda r, x: r <= -x).alias("stop_at"))
    g = found.select("*", F.inline(grid))
    w, s = F.element_at("win_at", F.col("i")), F.element_at("stop_at", F.col("j"))
    won, stopped = (w > 0) & (w <= F.col("h")), (s > 0) & (s <= F.col("h"))
    stop_first = stopped & (~won | (s < w))
    return g.select(
        "symbol", "date", "tp", "sl", "h",
        F.when(stop_first, -F.col("sl")).when(won, F.col("tp")).otherwise(F.element_at("marks", F.col("m"))).alias("ret"),
        F.when(stop_first, s).when(won, w).otherwise(F.least("h", "seen")).alias("hold"),
        F.when(stop_first, "stop").when(won, "win").otherwise("timeout").alias("outcome"))


def trade_grid(paths: DataFrame, cells: Sequence[Cell]) -> DataFrame:
    """Outcome statistics of every (tp, sl, bars) cell; picks are top-k per date."""
    runs = grid_outcomes(paths, cells)
    ret, kind = F.col("ret"), F.col("outcome")

    def share(name: str) -> Column:
        return F.avg((kind == name).cast("double")) * 100

    gains = F.sum(F.when(ret > 0, ret).otherwise(0.0))
    losses = -F.sum(F.when(ret < 0, ret).otherwise(0.0))
    stats = runs.groupBy("tp", "sl", "h").agg(
        F.count(F.lit(1)).alias("n"),
        share("win").alias("win_pct"), share("stop").alias("stop_pct"), share("timeout").alias("timeout_pct"),
        F.avg(ret).alias("avg_ret"), F.median(ret).alias("median_ret"), F.avg("hold").alias("avg_hold"),
        gains.alias("_g"), losses.alias("_l"))
    return stats.withColumns({
        "ret_per_session": F.try_divide("avg_ret", "avg_hold"),
        "profit_factor": F.when(F.col("_l") > 0, F.col("_g") / F.col("_l")).otherwise(F.lit(float("inf"))),
    }).drop("_g", "_l")


def search_cells(t: Thresholds = DEFAULTS) -> list[Cell]:
    """Every cell the search may look at: sweeps around any target, and the joint grid."""
    cells = {(float(tp), float(sl), t.primary_horizon) for tp in TP_GRID for sl in {*SL_GRID, t.primary_sl}}
    cells |= {(float(tp), t.primary_sl, h) for tp in TP_GRID for h in HORIZON_GRID}
    cells |= {(float(tp), float(sl), h) for tp in COMBO_TP_GRID for sl in COMBO_SL_GRID for h in COMBO_HORIZON_GRID}
    return sorted(cells)


def parameter_search(paths: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """The four sweeps with their best cells marked, from one pass over the picks.

    ``sweep`` is target, stop, horizon or joint; stop and horizon run at the target with
    the best mean return.  The grid has about a hundred rows, so the follow-up is tiny.
    """
    grid = trade_grid(paths, search_cells(t))
    on_target = (F.col("sl") == t.primary_sl) & (F.col("h") == t.primary_horizon) & F.col("tp").isin(
        *[float(x) for x in TP_GRID])
    best_tp = grid.where(on_target).agg(F.max_by("tp", F.struct("avg_ret", -F.col("tp")))).scalar()
    joint = (F.col("tp").isin(*[float(x) for x in COMBO_TP_GRID]) & F.col("sl").isin(*[float(x) for x in COMBO_SL_GRID])
             & F.col("h").isin(*COMBO_HORIZON_GRID))
    at_best = F.col("tp") == best_tp
    sweeps = F.array_compact(F.array(
        F.when(on_target, "target"),
        F.when(at_best & (F.col("h") == t.primary_horizon) & F.col("sl").isin(*[float(x) for x in SL_GRID]), "stop"),
        F.when(at_best & (F.col("sl") == t.primary_sl) & F.col("h").isin(*HORIZON_GRID), "horizon"),
        F.when(joint, "joint")))
    return grid.withColumn("sweep", F.explode(sweeps))


def best_cells(search: DataFrame) -> DataFrame:
    """Best target by mean return and by return per session, and the best joint cell."""
    def best(rows: DataFrame, by: str, label: str) -> DataFrame:
        cell = F.struct("tp", "sl", "h", "n", "win_pct", "avg_ret", "ret_per_session", "avg_hold", "profit_factor")
        order = F.struct(F.col(by), -F.col("tp"), -F.col("sl"), -F.col("h"))
        return rows.agg(F.max_by(cell, order).alias("c")).select(F.lit(label).alias("choice"), "c.*")

    target = search.where(F.col("sweep") == "target")
    return (best(target, "avg_ret", "target_by_return")
            .unionByName(best(target, "ret_per_session", "target_by_session"))
            .unionByName(best(search.where(F.col("sweep") == "joint"), "avg_ret", "joint_by_return")))


# ---- ranking validation and profiles ------------------------------------------

def validate_rankings(panel: DataFrame, indicators: DataFrame, k: int = 10) -> DataFrame:
    """Precision of two indicator-only rankings on the same labels."""
    cols = ["trend_template_pass", "range_contraction_ratio", "rel_volume", "rs_vs_market"]
    labels = [f"{p}_{h}d" for h in HORIZONS for p in ("upside_touched", "future_max")]
    merged = panel.select("symbol", "date", *labels).join(
        indicators.select("symbol", "date", *cols), ["symbol", "date"])
    structure = (
        F.coalesce(F.col("trend_template_pass"), F.lit(False)).cast("int") * 10
        + F.coalesce(F.col("range_contraction_ratio") < 0.7, F.lit(False)).cast("int") * 5
        + F.coalesce(F.least(F.col("rel_volume"), F.lit(5.0)), F.lit(0.0)))
    scored = merged.select("symbol", "date", *labels, F.inline(F.array(
        F.struct(F.lit("structure").alias("ranking"), structure.alias("s")),
        F.struct(F.lit("relative_strength").alias("ranking"), F.col("rs_vs_market").alias("s")))))
    scored = scored.where(F.col("s").isNotNull())
    long = by_horizon(scored, "ranking", "date", "symbol", "s")
    keys = ["ranking", "date", "horizon_days"]
    top = top_k(long, keys, best_first("s"), k).groupBy(*keys).agg(F.avg("touched").alias("precision_at_k"))
    base = long.groupBy(*keys).agg(F.avg("touched").alias("baseline_win_rate"))
    return precision_summary(top.join(base, keys), ["ranking"])


def profile(panel: DataFrame) -> DataFrame:
    """Rows, distinct symbols and dates, first and last date."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"),
        F.countDistinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def quality_rates(indicators: DataFrame) -> DataFrame:
    """Share of rows with 200 trusted bars, and pass rate where the template is known."""
    return indicators.agg(
        F.avg((F.col("bars_since_gap") >= 200).cast("double")).alias("trusted_200_share"),
        F.avg(F.col("trend_template_pass").cast("double")).alias("template_pass_rate"))
