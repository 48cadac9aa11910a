"""Feature tests, screener intelligence and event precedence on labeled data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import EXIT_RULES
from ..functions.screeners import normalize_screener
from ..functions.scoring import is_true
from ..operators.asof import next_bar_map, next_session
from ..operators.labels import exit_simulation, fixed_outcome
from ..operators.ranking import average_rank, group_quantile, percentile_rank, top_k
from ..operators.text import precedence_mentions
from ..operators.timeseries import add_delivery_ratio, add_gap_features
from ..session import cut_lineage
from ..settings import DEFAULTS, HIGH_FREQUENCY_DESKS, Thresholds
from .evaluation import best_first, daily_picks


def resolved(panel: DataFrame) -> DataFrame:
    """Rows whose trade is decided, with 0/1 ``win`` and ``touch``."""
    return panel.where(F.col("tradable_win").isin(0, 1)).withColumns({
        "win": F.col("tradable_win").cast("int"),
        "touch": F.coalesce(F.col("upside_touched_20d"), F.lit(0)).cast("int"),
    })


def ranked_shortlist(panel: DataFrame, k: int = 40, *, rank_scope: str = "resolved", score: str = "score") -> DataFrame:
    """Top ``k`` per date with ``rank``, among decided rows or among all rows."""
    if rank_scope == "resolved":
        return top_k(resolved(panel), ["date"], best_first(score), k, "rank")
    if rank_scope == "all":
        return resolved(top_k(panel, ["date"], best_first(score), k, "rank"))
    raise ValueError("rank_scope is 'resolved' or 'all'")


# ---- market and sector context --------------------------------------------------

def breadth_history(indicators: DataFrame) -> DataFrame:
    """Per date: share above the 50-bar average (unknown counts as not above), benchmark drift."""
    above = F.coalesce(F.col("close") > F.col("sma50"), F.lit(False)).cast("double")
    return indicators.groupBy("date").agg(
        F.avg(above).alias("breadth"), F.max("benchmark_ret_20d").alias("bench20"))


def breadth_live(indicators: DataFrame) -> DataFrame:
    """Per date: share above the 50-bar average among rows that have one."""
    known = F.col("close").isNotNull() & F.col("sma50").isNotNull()
    return indicators.groupBy("date").agg(
        F.avg(F.when(known, (F.col("close") > F.col("sma50")).cast("double"))).alias("breadth"),
        F.count_if(known).alias("universe"))


def sector_strength(indicators: DataFrame, sectors: DataFrame) -> DataFrame:
    """(date, sector, sector_rs, sector_pct): median strength and its rank per date."""
    known = indicators.select("symbol", "date", "rs_vs_market").join(sectors, "symbol").where(
        F.col("sector").isNotNull())
    medians = group_quantile(known, ["date", "sector"], "rs_vs_market", 0.5, "sector_rs")
    return percentile_rank(medians, ["date"], "sector_rs", "sector_pct")


def feature_frame(panel: DataFrame, indicators: DataFrame, sectors: DataFrame) -> DataFrame:
    """Labeled rows with delivery trend, squeeze, sector strength and market context."""
    own = add_delivery_ratio(indicators).select(
        "symbol", "date", "deliv_ratio", "range_contraction_ratio")
    strength = sector_strength(indicators, sectors).select("date", "sector", "sector_pct")
    day = breadth_history(indicators)
    return (
        panel.select("symbol", "date", "sector", "score", "screeners", "tradable_win", "upside_touched_20d")
        .join(own, ["symbol", "date"], "left").join(strength, ["date", "sector"], "left").join(day, "date", "left"))


def verdict(edge: Column, pos_win: Column, base: Column, pos_n: Column, neg_n: Column) -> Column:
    return (
        F.when((pos_n < 40) | (neg_n < 40), "n/a")
        .when((edge >= 4) & (pos_win > base), "EDGE")
        .when(edge >= 1.5, "weak")
        .otherwise("none"))


def split_tests(rows: DataFrame, tests: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Positive against negative cohort per test; an unknown feature counts as negative.

    A test is (universe, feature), both conditions on ``rows``.  All tests are counted in one
    aggregate and unfolded into one row each.
    """
    counted = []
    for name, (universe, mask) in tests.items():
        pos, within = is_true(mask), is_true(universe)

        def rate(col: str, side: Column) -> Column:
            return F.avg(F.when(side, F.col(col))) * 100

        counted.append(F.struct(
            F.count_if(within & pos).alias("pos_n"), F.count_if(within & ~pos).alias("neg_n"),
            rate("win", within & pos).alias("pos_win"), rate("win", within & ~pos).alias("neg_win"),
            rate("touch", within & pos).alias("pos_touch"), rate("touch", within & ~pos).alias("neg_touch"),
            rate("win", within).alias("base_win"), F.lit(name).alias("test")))
    out = rows.agg(F.array(*counted).alias("t")).select(F.inline("t")).withColumn("edge", F.col("pos_win") - F.col("neg_win"))
    return out.withColumn("verdict", verdict(
        F.col("edge"), F.col("pos_win"), F.col("base_win"), F.col("pos_n"), F.col("neg_n")))


def feature_tests(features: DataFrame) -> DataFrame:
    """The five standing feature tests within the daily top 10 or top 40.

    The shortlist, at most 40 rows per date, is ranked once and stored; its exact quantile
    state is bounded by the calendar.  ``features`` is read once more for the breadth of all days.
    """
    short = cut_lineage(ranked_shortlist(features, 40), "shortlist")
    top10, all_of_it = F.col("rank") <= 10, F.lit(True)
    per_day = resolved(features).where(F.col("breadth").isNotNull()).groupBy("date", "breadth").agg(
        F.count(F.lit(1)).alias("n"))
    median_breadth = per_day.agg(F.percentile("breadth", 0.5, F.col("n"))).scalar()
    tight = short.agg(F.percentile("range_contraction_ratio", 0.33)).scalar()
    return split_tests(short, {
        "F1 breadth": (top10, F.col("breadth") > median_breadth),
        "F1b benchmark trend": (top10, F.col("bench20") > 0),
        "F2 sector strength": (all_of_it, F.col("sector_pct") >= 0.75),
        "F3 delivery trend": (all_of_it, F.col("deliv_ratio") >= 1.3),
        "F4 squeeze": (all_of_it, F.col("range_contraction_ratio") <= tight),
    })


def base_rates(panel: DataFrame) -> DataFrame:
    """Decided rows, dates and base rates of the universe and its daily shortlists."""
    short = ranked_shortlist(panel, 40).select("win", "touch", "rank")
    lists = short.select("win", "touch", F.explode(F.when(F.col("rank") <= 10, F.array(
        F.lit("top10"), F.lit("top40"))).otherwise(F.array(F.lit("top40")))).alias("scope"))
    everything = resolved(panel).select("win", "touch", F.lit("all").alias("scope"))
    return everything.unionByName(lists).groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"), (F.avg("win") * 100).alias("win_pct"), (F.avg("touch") * 100).alias("touch_pct"))


# ---- screener intelligence ---------------------------------------------------------

def screener_names(screeners: Column, normalize: bool) -> Column:
    return F.array_distinct(F.transform(screeners, normalize_screener)) if normalize else screeners


def screener_win_rates(short: DataFrame, *, min_n: int = 60, normalize: bool = False, keys=()) -> DataFrame:
    rows = short.select(*keys, "win", F.explode(screener_names(F.col("screeners"), normalize)).alias("screener"))
    return rows.groupBy(*keys, "screener").agg(
        F.count(F.lit(1)).alias("n"), F.sum("win").alias("wins")
    ).where(F.col("n") >= min_n).withColumn("win_rate", F.col("wins") / F.col("n") * 100)


def screener_spread(rates: DataFrame) -> DataFrame:
    best, worst = F.max("win_rate"), F.min("win_rate")
    return rates.agg(
        F.count(F.lit(1)).alias("screeners"), best.alias("best"), worst.alias("worst"),
        (best - worst).alias("spread"),
        F.when(best - worst >= 8, "EDGE").otherwise("weak").alias("verdict"))


def screener_weights(short: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Weights from measured win rates: scaled above the floor, neutral when thin."""
    rates = screener_win_rates(short, min_n=t.weight_drop_n, normalize=True)
    scaled = F.bround((F.col("win_rate") - t.weight_floor) * t.weight_scale, 0).cast("int")
    weight = F.when(F.col("n") >= t.weight_min_n, F.least(F.greatest(scaled, F.lit(0)), F.lit(t.weight_cap)))
    return rates.select(
        "screener", F.bround("win_rate", 1).alias("win_rate"), "n",
        F.coalesce(weight, F.lit(t.neutral_weight)).alias("weight"),
    ).orderBy(F.col("win_rate").desc(), "screener")


def median_date(short: DataFrame) -> DataFrame:
    """One row: the median row date as a day number, from counts per date."""
    days = short.groupBy(F.unix_date("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(F.percentile("d", 0.5, F.col("n")).alias("cut"))


def split_half_rates(short: DataFrame, *, min_n: int = 30, normalize: bool = True) -> DataFrame:
    cut = median_date(short).scalar()
    halves = short.withColumn("half", F.when(F.unix_date("date") <= cut, "first").otherwise("second"))
    return screener_win_rates(halves, min_n=min_n, normalize=normalize, keys=("half",))


def split_half_stability(short: DataFrame, *, min_n: int = 30, min_common: int = 8, normalize: bool = True) -> DataFrame:
    """Rank correlation of screener win rates between halves (a few dozen screeners)."""
    rates = split_half_rates(short, min_n=min_n, normalize=normalize)
    pair = rates.groupBy("screener").agg(
        F.max(F.when(F.col("half") == "first", F.col("win_rate"))).alias("a"),
        F.max(F.when(F.col("half") == "second", F.col("win_rate"))).alias("b"),
    ).dropna().withColumn("_all", F.lit(1))
    ranked = average_rank(average_rank(pair, ["_all"], "a", "ra"), ["_all"], "b", "rb")
    # without spread on one side there is no correlation; corr would divide by zero
    every = Window.partitionBy("_all")
    spread = reduce(Column.__and__, [F.min(r).over(every) < F.max(r).over(every) for r in ("ra", "rb")])
    ranked = ranked.withColumn("ra", F.when(spread, F.col("ra")))
    rho = F.when(F.count(F.lit(1)) >= min_common, F.corr("ra", "rb"))
    return ranked.agg(F.count(F.lit(1)).alias("common"), rho.alias("rank_corr")).withColumn(
        "verdict", F.when(F.col("rank_corr").isNull(), "n/a")
        .when(F.col("rank_corr") >= 0.35, "STABLE").otherwise("UNSTABLE"))


# ---- events before moves --------------------------------------------------------------

def _cohort(label: str, keep: Column) -> Column:
    return F.when(keep, F.lit(label))


def cohort_outcomes(rows: DataFrame, cohorts: dict[str, Column], weight: str | None = None) -> DataFrame:
    """n, win percent of decided rows and mean forward peak per cohort (cohorts may overlap)."""
    w = F.col(weight) if weight else F.lit(1)
    labels = F.array_compact(F.array(*[_cohort(k, is_true(c)) for k, c in cohorts.items()]))
    known = F.when(F.col("tpsl").isNotNull(), w)
    return rows.select("*", F.explode(labels).alias("cohort")).groupBy("cohort").agg(
        F.sum(w).cast("long").alias("n"),
        (F.try_divide(F.sum(F.col("tpsl") * w), F.sum(known)) * 100).alias("win_pct"),
        (F.try_divide(F.sum(F.col("fwd_max20") * w), F.sum(F.when(F.col("fwd_max20").isNotNull(), w))) * 100).alias("mean_peak_pct"))


def pivot_follow_through(indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Decided episodic pivots: all, held and faded."""
    gaps = add_gap_features(indicators, t=t).where("ep_raw").select("symbol", "date", "close_pos")
    rows = gaps.join(fixed_outcome(indicators), ["symbol", "date"]).where(F.col("tpsl").isNotNull())
    return cohort_outcomes(rows, {
        "all": F.lit(True), "held": F.col("close_pos") >= 0.5, "faded": F.col("close_pos") < 0.5})


def mention_precedence(messages: DataFrame, listed: DataFrame, bars: DataFrame, *, per_symbol: bool = True,
                       forward_room_days: int | None = None) -> DataFrame:
    """Outcome after mentions: all, broadcast channel, members.

    Mentions are counted per (symbol, day, channel) before they meet the bars, so a
    symbol or day with most of the mentions is a handful of weighted rows.  The bars are
    written once for the end date, the map and the outcomes.
    """
    bars = cut_lineage(bars.select("symbol", "date", "close"), "bars")
    hits = precedence_mentions(messages, listed)
    if forward_room_days is not None:
        end = bars.agg(F.date_sub(F.max("date"), forward_room_days)).scalar()
        hits = hits.where(F.col("date") <= end)
    counted = hits.groupBy("symbol", F.col("date").alias("said"), "admin").agg(F.count(F.lit(1)).alias("w"))
    if per_symbol:
        placed = counted.join(next_bar_map(counted, bars, "said"), ["symbol", "said"])
    else:
        placed = next_session(counted, bars, "said")
    rows = placed.join(fixed_outcome(bars), ["symbol", "date"]).where(F.col("fwd_max20").isNotNull())
    return cohort_outcomes(
        rows, {"all": F.lit(True), "admin": F.col("admin"), "member": ~F.col("admin")}, "w")


def is_high_frequency(client: Column, desks: list[str] | None = None) -> Column:
    names = HIGH_FREQUENCY_DESKS if desks is None else desks
    pattern = "|".join(rf"\Q{n}\E" for n in names)
    return is_true(F.upper(client).rlike(pattern))


def fund_buys(deals: DataFrame, desks: list[str] | None = None) -> DataFrame:
    """Buy-side deals without high-frequency desks."""
    buy = F.upper(F.trim("side")).startswith("B")
    return deals.where(buy & ~is_high_frequency(F.col("client"), desks))


def deal_precedence(deals: DataFrame, bars: DataFrame, desks: list[str] | None = None) -> DataFrame:
    """Outcome after fund buys, on the first market date at or after the deal; the bars are written once."""
    bars = cut_lineage(bars.select("symbol", "date", "close"), "bars")
    counted = fund_buys(deals, desks).groupBy("symbol", F.col("date").alias("dealt")).agg(
        F.count(F.lit(1)).alias("w"))
    rows = next_session(counted, bars, "dealt").join(fixed_outcome(bars), ["symbol", "date"]).where(
        F.col("fwd_max20").isNotNull())
    return cohort_outcomes(rows, {"fund buys": F.lit(True)}, "w")


# ---- exits -----------------------------------------------------------------------------

def exit_rule_table(panel: DataFrame, indicators: DataFrame, k: int = 10, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Expectancy of the five exit rules over the daily top k (all rows are ranked)."""
    runs = exit_simulation(daily_picks(panel, k), indicators, t=t)
    pct = F.col("ret") * 100
    stats = runs.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pct).alias("expectancy"),
        (F.avg((pct > 0).cast("double")) * 100).alias("win_pct"),
        F.coalesce(F.avg(F.when(pct > 0, pct)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(pct <= 0, pct)), F.lit(0.0)).alias("avg_loss"))
    fixed = F.max(F.when(F.col("rule") == "A", F.col("expectancy"))).over(_five_rules())
    names = F.create_map(*[F.lit(x) for key, (label, _) in EXIT_RULES.items() for x in (key, label)])
    return stats.withColumns({"delta_vs_fixed": F.col("expectancy") - fixed, "name": F.try_element_at(names, F.col("rule"))})


def _five_rules():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))
