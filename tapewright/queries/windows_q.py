"""Per-symbol windows, indicators and forward paths (W rows of the inventory)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import timeseries as TS
from ..operators.ranking import add_deciles, group_quantile, percentile_rank, positions, top_k
from ..session import cut_lineage
from ..settings import HORIZONS, TRUSTED_AFTER_BARS
from ..sources import market_tables as M
from . import blocks as B
from .frames import T, indicators, sheet
from .registry import query

R = 6
IND_SQL = B.with_(B.BARS, B.INDICATORS)


def rounded(df, *cols, places=R):
    return df.withColumns({c: F.round(c, places) for c in cols})


def pick(*cols):
    return ", ".join(f"round({c}, {R}) as {c}" for c in cols)


@query("w01_gap_segments", B.with_(B.BARS, B.segments()) + " select symbol, date, seg, bars_since_gap from seg2")
def w01(spark, sf):
    return TS.add_segments(M.bars(spark, sf), t=T).select("symbol", "date", "seg", "bars_since_gap")


@query("w02_true_range", B.with_(B.BARS, B.segments(), B.TRUE_RANGE) + f" select symbol, date, {pick('tr')} from tr0")
def w02(spark, sf):
    df = TS.add_true_range(TS.add_segments(M.bars(spark, sf), t=T)).select("symbol", "date", "tr")
    return rounded(df, "tr")


def _ind(cols, fn=None):
    def run(spark, sf):
        df = TS.add_indicators(M.bars(spark, sf), t=T)
        return rounded(df.select("symbol", "date", *cols), *cols)
    return run


for _name, _cols in {
    "w03_atr": ["atr14", "atr_pct"],
    "w04_moving_averages": ["sma20", "sma50", "sma150", "sma200"],
    "w05_year_high_low": ["pct_from_52w_high", "pct_from_52w_low"],
    "w07_range_contraction": ["range_contraction_ratio"],
    "w08_relative_volume": ["rel_volume"],
}.items():
    query(_name, f"{IND_SQL} select symbol, date, {pick(*_cols)} from ind")(_ind(_cols))


@query("w06_trend_template", IND_SQL + " select symbol, date, trend_template_pass from ind")
def w06(spark, sf):
    return TS.add_indicators(M.bars(spark, sf), t=T).select("symbol", "date", "trend_template_pass")


@query("w09_relative_strength", IND_SQL + f" select symbol, date, {pick('ret_20d', 'benchmark_ret_20d', 'rs_vs_market')} from ind")
def w09(spark, sf):
    cols = ["ret_20d", "benchmark_ret_20d", "rs_vs_market"]
    return rounded(indicators(spark, sf).select("symbol", "date", *cols), *cols)


_known = ", ".join(f"count({c}) as {c}" for c in TRUSTED_AFTER_BARS)


@query("w10_trust_masking", IND_SQL + f" select symbol, {_known} from ind group by symbol")
def w10(spark, sf):
    df = TS.add_indicators(M.bars(spark, sf), t=T)
    return df.groupBy("symbol").agg(*[F.count(c).alias(c) for c in TRUSTED_AFTER_BARS])


@query("w11_percentile_rank", B.with_(B.BARS) + f"""
  select symbol, date, round((rank() over (partition by date order by volume)
    + (count(*) over (partition by date, volume) - 1) / 2.0) / count(volume) over (partition by date), {R}) as volume_pct from bars""")
def w11(spark, sf):
    df = percentile_rank(M.bars(spark, sf).select("symbol", "date", "volume"), ["date"], "volume", "volume_pct")
    return rounded(df, "volume_pct").drop("volume")


_FRACTIONS = ", ".join(repr(i * 0.1) + "::double" for i in range(10)) + ", 1.0::double"
DECILES_SQL = f"""
score_counts as (
  select date, score, ties, n_less, n, count(*) over (partition by date) as n_scores from (
    select date, score, ties, sum(ties) over (partition by date order by score) - ties as n_less,
      sum(ties) over (partition by date) as n
    from (select date, score, count(*) as ties from gated where score is not null group by date, score))),
cuts as (select date, any_value(n) as n, unnest([{_FRACTIONS}]) * (any_value(n) - 1)::double as pos
  from score_counts where n_scores >= 2 group by date),
edge_rows as (
  select c.date, lo.score + (hi.score - lo.score) * (pos - floor(pos)) as low_form,
    hi.score - (hi.score - lo.score) * (1 - (pos - floor(pos))) as high_form, pos - floor(pos) as g
  from cuts c
  join score_counts lo on lo.date = c.date and lo.n_less <= floor(pos) and floor(pos) < lo.n_less + lo.ties
  join score_counts hi on hi.date = c.date and hi.n_less <= ceil(pos) and ceil(pos) < hi.n_less + hi.ties),
edges as (select date, list(distinct case when g >= 0.5 then high_form else low_form end) as edges from edge_rows group by date),
deciled as (
  select g.*, greatest(len(list_filter(e.edges, lambda x: x < g.score)) - 1, 0)::int as decile
  from gated g join edges e on e.date = g.date where g.score is not null)"""


@query("w12_score_deciles", B.with_(B.SCORED, DECILES_SQL) + " select symbol, date, score, decile from deciled")
def w12(spark, sf):
    from .frames import gated
    g = cut_lineage(gated(spark, sf).select("symbol", "date", "score"), "scores")
    counts = g.groupBy("date", "score").agg(F.count(F.lit(1)).alias("n"))
    return g.join(add_deciles(counts, ["date"], "score", "n").drop("n"), ["date", "score"])


@query("w13_daily_top_k", IND_SQL + f"""
  select symbol, date, {pick('rs_vs_market')}, rn::int as rn from (select *, row_number() over (
    partition by date order by rs_vs_market desc, symbol) as rn from ind where rs_vs_market is not null) where rn <= 10""")
def w13(spark, sf):
    df = indicators(spark, sf).where(F.col("rs_vs_market").isNotNull()).select("symbol", "date", "rs_vs_market")
    return rounded(top_k(df, ["date"], [F.col("rs_vs_market").desc(), F.col("symbol")], 10, "rn"), "rs_vs_market")


AS_OF = "1999-06-30"
SHEET_DAY = "1998-12-01"


@query("w14_snapshot_as_of", IND_SQL + f"""
  select symbol, date, bars_since_gap, {pick('close', 'rs_vs_market', 'atr_pct')} from (
    select *, row_number() over (partition by symbol order by date desc) as rn from ind where date <= date '{AS_OF}')
  where rn = 1 and date '{AS_OF}' - date <= 7""")
def w14(spark, sf):
    df = TS.latest_as_of(indicators(spark, sf), AS_OF, t=T)
    cols = ["close", "rs_vs_market", "atr_pct"]
    return rounded(df.select("symbol", "date", "bars_since_gap", *cols), *cols)


@query("w15_post_signal_stats", B.with_(B.BARS) + f"""
  select symbol, max(date) as latest_date, arg_max(close, date) as latest_price,
    max(close) as peak_price, min(date) filter (where close = mx) as peak_date
  from (select *, max(close) over (partition by symbol) as mx from bars where date >= date '{AS_OF}') group by symbol""")
def w15(spark, sf):
    return TS.post_signal_stats(M.bars(spark, sf), AS_OF)


LAB_SQL = B.with_(B.SHEET, B.LABELS)


@query("w16_forward_path", LAB_SQL + f"""
  select symbol, date, count(*)::int as steps, round(sum(r), 8) as total, round(max(r), {R}) as best,
    round(arg_max(r, k), {R}) as last from lp group by symbol, date""")
def w16(spark, sf):
    b = TS.add_segments(M.bars(spark, sf).withColumnRenamed("close", "price"), t=T)
    df = TS.forward_returns(b, 30, price="price", max_abs=T.max_abs_return).where(F.size("path") > 0)
    p = F.col("path")
    return rounded(df.select(
        "symbol", "date", F.size(p).alias("steps"),
        F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 8).alias("total"),
        F.array_max(p).alias("best"), F.element_at(p, -1).alias("last")), "best", "last")


_maxes = [f"future_max_{h}d" for h in HORIZONS]
_touches = [f"upside_touched_{h}d" for h in HORIZONS]


@query("w17_horizon_labels", LAB_SQL + f"""
  select s.symbol, s.date, {pick(*_maxes)}, {', '.join(_touches)}
  from sheet s left join lab l on l.symbol = s.symbol and l.date = s.date""")
def w17(spark, sf):
    df = L.add_labels(sheet(spark, sf).select("symbol", "date", "price"), t=T)
    return rounded(df.select("symbol", "date", *_maxes, *_touches), *_maxes)


@query("w18_first_hit_label", B.with_(B.SHEET, B.labels(tp=12, sl=-8)) + """
  select s.symbol, s.date, tradable_win from sheet s left join lab l on l.symbol = s.symbol and l.date = s.date""")
def w18(spark, sf):
    t = replace(T, tp_pct=12.0, sl_pct=-8.0)
    return L.add_labels(sheet(spark, sf).select("symbol", "date", "price"), t=t).select("symbol", "date", "tradable_win")


FIXED_SQL = B.path_cte("bars", "close", 20, "symbol", None, 1, "fp") + """,
fixed0 as (select symbol, date, max(r) as fwd_max20, max(k) as nk,
   arg_min(r, k) filter (where r <= -0.08 or r >= 0.20) as hit from fp group by symbol, date),
fixed as (select b.symbol, b.date, fwd_max20, case when hit is not null then case when hit <= -0.08 then 0 else 1 end
   when nk >= 20 then 0 end as tpsl from bars b left join fixed0 f on f.symbol = b.symbol and f.date = b.date)"""


@query("w19_fixed_outcome", B.with_(B.BARS, FIXED_SQL) + f" select symbol, date, {pick('fwd_max20')}, tpsl from fixed")
def w19(spark, sf):
    return rounded(L.fixed_outcome(M.bars(spark, sf)), "fwd_max20")


@query("w20_trade_resolution", LAB_SQL + f""", rt as (
  select symbol, date, max(k)::int as nk, arg_max(r, k) as last, min(k) filter (where r <= -8 or r >= 20) as hit_k,
    arg_min(r, k) filter (where r <= -8 or r >= 20) as hit from lp group by symbol, date)
  select symbol, date, round(case when hit <= -8 then -8.0 when hit >= 20 then 20.0 else last end, {R}) as ret,
    coalesce(hit_k, nk)::int as hold, case when hit <= -8 then 'stop' when hit >= 20 then 'win' else 'timeout' end as outcome
  from rt""")
def w20(spark, sf):
    from ..functions.paths import resolve_trade
    b = TS.add_segments(M.bars(spark, sf).withColumnRenamed("close", "price"), t=T)
    df = TS.forward_returns(b, 30, price="price", max_abs=T.max_abs_return).where(F.size("path") > 0)
    out = resolve_trade(F.col("path"), F.lit(20.0), F.lit(8.0), F.lit(30))
    return rounded(df.select("symbol", "date", out.alias("o")).select("symbol", "date", "o.*"), "ret")


PERSIST = """
persist as (
  select *, case when count(*) over w >= 5 then sum(case when rs_vs_market >= 15 then 1 else 0 end) over w end::int as persist20
  from ind window w as (partition by symbol order by date rows between 19 preceding and current row))"""


@query("w23_rolling_leader_days", B.with_(B.BARS, B.INDICATORS, PERSIST) + " select symbol, date, persist20 from persist")
def w23(spark, sf):
    df = TS.add_persistence(indicators(spark, sf), t=T)
    return df.select("symbol", "date", F.col("persist20").cast("int").alias("persist20"))


GAPS = """
gaps0 as (select *, (open / pc - 1) * 100 as gap_pct, case when high > low then (close - low) / (high - low) end as close_pos from ind),
gaps as (select *, coalesce(gap_pct >= 4, false) and coalesce(rel_volume >= 3, false) as ep_raw from gaps0)"""


@query("w24_episodic_pivot", B.with_(B.BARS, B.INDICATORS, GAPS) + f"""
  select symbol, date, {pick('gap_pct', 'close_pos')}, ep_raw, ep_raw and coalesce(close_pos >= 0.5, true) as ep,
    ep_raw and coalesce(close_pos < 0.5, false) as ep_fade from gaps""")
def w24(spark, sf):
    df = TS.add_gap_features(indicators(spark, sf), t=T)
    return rounded(df.select("symbol", "date", "gap_pct", "close_pos", "ep_raw", "ep", "ep_fade"), "gap_pct", "close_pos")


@query("w27_delivery_ratio", B.with_(B.BARS) + f"""
  select symbol, date, round(deliv_per / nullif(case when count(deliv_per) over w >= 5 then avg(deliv_per) over w end, 0), {R}) as deliv_ratio
  from bars window w as (partition by symbol order by date rows between 19 preceding and current row)""")
def w27(spark, sf):
    return rounded(TS.add_delivery_ratio(M.bars(spark, sf)).select("symbol", "date", "deliv_ratio"), "deliv_ratio")


@query("w30_daily_head", B.with_(B.BARS, B.SECTORS) + """
  select sector, date, symbol, volume from (
    select b.*, s.sector, row_number() over (partition by sector, date order by volume desc, b.symbol) as rn
    from bars b join sectors s on s.symbol = b.symbol) where rn <= 3""")
def w30(spark, sf):
    df = M.bars(spark, sf).join(M.sectors(spark, sf), "symbol").select("sector", "date", "symbol", "volume")
    return top_k(df, ["sector", "date"], [F.col("volume").desc(), F.col("symbol")], 3)


@query("w11b_grouped_median", B.with_(B.BARS, B.SECTORS) + f"""
  select sector, round(median(close), {R}) as mid, round(quantile_cont(close, 0.33), {R}) as third
  from bars b join sectors s on s.symbol = b.symbol group by sector""")
def w11b(spark, sf):
    df = M.bars(spark, sf).join(M.sectors(spark, sf), "symbol").select("sector", "close")
    out = group_quantile(df, ["sector"], "close", 0.5, "mid").join(
        group_quantile(df, ["sector"], "close", 0.33, "third"), "sector")
    return rounded(out, "mid", "third")


@query("w13b_full_daily_positions", B.with_(B.BARS) + """
  select symbol, date, row_number() over (partition by date order by volume desc, symbol)::int as pos from bars""")
def w13b(spark, sf):
    df = M.bars(spark, sf).select("symbol", "date", "volume")
    return positions(df, ["date"], [F.col("volume").desc(), F.col("symbol")], "pos").drop("volume")


FLAGSHIP = B.labels("closes", tp=12, sl=-8) + """,
ranked as (select i.symbol, i.date, l.tradable_win, row_number() over (partition by i.date order by i.rs_vs_market desc, i.symbol) as rn
  from ind i join lab l on l.symbol = i.symbol and l.date = i.date where i.rs_vs_market is not null and l.tradable_win is not null)"""


def leaders_against_market(spark, sf, t):
    """Per date: win rate of the ten strongest symbols beside that of all symbols."""
    from ..plans.evaluation import precision_at_k_tradable
    b = M.bars(spark, sf)
    labels = L.add_labels(b.select("symbol", "date", F.col("close").alias("price")), t=t)
    ind = TS.add_relative_strength(TS.add_indicators(b, t=t), t=t)
    both = ind.select("symbol", "date", "rs_vs_market").join(
        labels.select("symbol", "date", "tradable_win"), ["symbol", "date"])
    return rounded(precision_at_k_tradable(both, 10, "rs_vs_market"), "precision_at_k", "baseline_win_rate")


FLAGSHIP_RULES = replace(T, tp_pct=12.0, sl_pct=-8.0)


@query("q00_leaders_against_market", B.with_(B.BARS, B.INDICATORS, "closes as (select symbol, date, close as price from bars)", FLAGSHIP) + f"""
  select date, 10 as k, round(avg(tradable_win) filter (where rn <= 10), {R}) as precision_at_k, round(avg(tradable_win), {R}) as baseline_win_rate,
    count(*) filter (where rn <= 10) as n_top from ranked group by date""")
def q00(spark, sf):
    return leaders_against_market(spark, sf, FLAGSHIP_RULES)


def flagship(spark, sf):
    """The same on the small tables, whose symbols rarely trade on consecutive days."""
    return leaders_against_market(spark, sf, replace(FLAGSHIP_RULES, max_gap_days=400))
