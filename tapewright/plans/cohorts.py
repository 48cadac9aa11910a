"""Use-case cohorts of the labeled history with rates and dated examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_true
from ..operators.ranking import top_k
from ..operators.timeseries import add_gap_features, add_persistence
from ..settings import DEFAULTS, Thresholds
from .research import ranked_shortlist, resolved

# Examples shown per cohort: (wins, losses); every other cohort shows 3 and 2.
FEWER_WINS = {"anti1": (2, 3), "anti2": (2, 3)}


def cohort_frame(panel: DataFrame, indicators: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Labeled rows with gap, relative volume and rolling leader days."""
    own = add_persistence(add_gap_features(indicators, t=t), t=t).select(
        "symbol", "date", "gap_pct", "persist20", F.col("rs_vs_market").alias("rs_ohlc"), F.col("rel_volume").alias("rvol"))
    keep = ["symbol", "date", "price", "score", "rs_vs_market", "rule_phase", "has_breakout_pattern",
            "new_screeners", "deliv_per", "future_max_30d", "upside_touched_20d", "tradable_win"]
    return panel.select(*keep).join(own, ["symbol", "date"], "left")


def cohort_rows(frame: DataFrame, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row per (cohort, decided row) with its sort value.

    The nine cohorts overlap, so each row carries the array of cohorts it belongs to and
    is unfolded once.  Store ``frame`` first: it is ranked and also used unranked.
    """
    short = ranked_shortlist(frame, 40).select("symbol", "date", "rank")
    df = resolved(frame).join(short, ["symbol", "date"], "left")
    c = F.col
    listed = c("rank").isNotNull()
    persistent = listed & is_true(c("persist20") >= t.persistent_days)
    broke = persistent & is_true(c("has_breakout_pattern"))
    fresh = F.size("new_screeners") > 0
    score = c("score").cast("double")

    def member(name, test, sort):
        return F.when(is_true(test) & sort.isNotNull(), F.struct(F.lit(name).alias("cohort"), sort.alias("sort_value")))

    cohorts = F.array_compact(F.array(
        member("uc1", c("rank") <= 10, score),
        member("uc2", persistent, score),
        member("uc3", broke & fresh, score),
        member("uc3_any", broke, score),
        member("uc4", listed & (c("gap_pct") >= t.pivot_gap_pct) & (c("rvol") >= t.pivot_rel_volume), c("rvol")),
        member("uc5", listed & (c("rule_phase") == "Breakout Trigger"), score),
        member("uc6", listed & (c("rule_phase") == "Rebound Setup"), score),
        member("uc7", (c("rvol") >= t.pivot_rel_volume) & c("rs_ohlc").between(0, t.emerging_max_rs) & (c("score") >= 50), c("rvol")),
        member("anti1", (c("score") >= 75) & (F.coalesce("persist20", F.lit(0)) <= 2), score),
        member("anti2", listed & (c("deliv_per") >= 80), c("deliv_per")),
    ))
    return df.select(F.inline(cohorts), "symbol", "date", "price", "score", "rs_vs_market", "win", "touch", "future_max_30d")


def with_fallback(rows: DataFrame, name: str = "uc3", fallback: str = "uc3_any", minimum: int = 5) -> DataFrame:
    """A cohort with fewer than ``minimum`` rows is replaced by its broader version."""
    few = rows.agg((F.count_if(F.col("cohort") == name) < minimum).alias("few")).scalar()
    drop, keep = F.when(few, name).otherwise(fallback), F.when(few, fallback).otherwise(name)
    return rows.where(F.col("cohort") != drop).withColumn(
        "cohort", F.when(F.col("cohort") == keep, name).otherwise(F.col("cohort")))


def cohort_rates(rows: DataFrame) -> DataFrame:
    """Rates over all rows of a cohort, with row and symbol counts.

    Symbols are made distinct before counting so that no task holds a cohort's symbols.
    """
    rates = rows.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.avg("win") * 100).alias("win_rate"), (F.avg("touch") * 100).alias("touch_rate"))
    names = rows.select("cohort", "symbol").distinct().groupBy("cohort").agg(F.count(F.lit(1)).alias("n_symbols"))
    return rates.join(names, "cohort")


def cohort_examples(rows: DataFrame) -> DataFrame:
    """Best row per symbol, then the top winners and losers of each cohort."""
    cols = ["date", "price", "score", "rs_vs_market", "win", "future_max_30d", "sort_value"]
    order = F.struct("sort_value", (-F.unix_date("date")).alias("d"))
    best = rows.groupBy("cohort", "symbol").agg(F.max_by(F.struct(*cols), order).alias("b")).select("cohort", "symbol", "b.*")
    ranked = top_k(best, ["cohort", "win"], [F.col("sort_value").desc(), F.col("symbol")], 3, "place")
    fewer = F.col("cohort").isin(*FEWER_WINS)
    quota = F.when(F.col("win") == 1, F.when(fewer, 2).otherwise(3)).otherwise(F.when(fewer, 3).otherwise(2))
    return ranked.where(F.col("place") <= quota)
