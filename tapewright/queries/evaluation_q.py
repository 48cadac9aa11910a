"""Aggregations over the labeled history (A rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets as SH
from ..operators.labels import exit_simulation
from ..operators.timeseries import add_gap_features
from ..plans import evaluation as E
from ..plans import research as RS
from ..session import cut_lineage
from ..settings import HORIZONS
from ..sources import market_tables as M
from . import blocks as B
from .frames import T, gated, indicators, labeled, stored_indicators
from .registry import query
from .windows_q import DECILES_SQL, FIXED_SQL, GAPS, IND_SQL, pick, rounded

LABELS = [f"{p}_{h}d" for h in HORIZONS for p in ("upside_touched", "future_max")]
SCORED = B.SCORED


def stored(spark, sf, *cols, gate=True):
    """The labeled history as a stored table of the needed columns, as daily runs keep it."""
    df = gated(spark, sf) if gate else labeled(spark, sf)
    return cut_lineage(df.select(*cols), "labeled")


# ---- sheet aggregations ------------------------------------------------------------

@query("a01_merge_hits", B.with_(B.BARS, B.HITS) + """ select h.symbol, h.date, array_to_string(list_sort(list(h.screener)), ', ') as screeners,
  count(*)::int as frequency, any_value(b.close) as price from hits h join bars b on b.symbol = h.symbol and b.date = h.date group by h.symbol, h.date""")
def a01(spark, sf):
    q = M.bars(spark, sf).select("symbol", "date", F.col("close").alias("price"))
    m = SH.merge_hits(M.screener_hits(spark, sf).join(q, ["symbol", "date"]), ("symbol", "date"))
    return m.select("symbol", "date", F.array_join("screeners", ", ").alias("screeners"), "frequency", "price")


@query("a02_deals_summary", B.with_(B.BARS, B.DEALS) + """ select symbol, date,
  sum(case when side = 'BUY' then quantity else 0.0 end) as buy_quantity, sum(case when side = 'SELL' then quantity else 0.0 end) as sell_quantity,
  count(*) filter (where side = 'BUY') as buy_count, count(*) filter (where side = 'SELL') as sell_count from deals group by symbol, date""")
def a02(spark, sf):
    return SH.deals_summary(M.deals(spark, sf), ("symbol", "date"))


TARGET_DAY = "1999-06-30"
_avgs = ", ".join(f"round(avg(case when rn <= {n} then {c} end), 6) as avg{n}_{c}" for c in ("deliv_qty", "deliv_per") for n in (3, 5, 10))


@query("a03_delivery_averages", B.with_(B.BARS) + f""" select symbol, max(date) as latest_date, arg_max(deliv_qty, date) as deliv_qty,
  round(arg_max(deliv_per, date), 6) as deliv_per, {_avgs} from (select *, row_number() over (partition by symbol order by date desc) as rn
    from bars where date <= date '{TARGET_DAY}') where rn <= 10 group by symbol having max(date) = date '{TARGET_DAY}'""")
def a03(spark, sf):
    df = SH.delivery_averages(M.bars(spark, sf), TARGET_DAY)
    return rounded(df, "deliv_per", *[f"avg{n}_{c}" for c in ("deliv_qty", "deliv_per") for n in (3, 5, 10)])


_pivot = ", ".join(f"sum(deliv_qty) filter (where dr = {i}) as d{i}_deliv_qty, round(avg(deliv_per) filter (where dr = {i}), 6) as d{i}_deliv_per" for i in range(1, 8))


@query("a04_delivery_pivot", B.with_(B.BARS) + f""", d as (select date, row_number() over (order by date desc) as dr from
  (select distinct date from bars where date <= date '{TARGET_DAY}')) select symbol, {_pivot} from bars b join d on d.date = b.date where dr <= 7 group by symbol""")
def a04(spark, sf):
    df = SH.delivery_pivot(M.bars(spark, sf), TARGET_DAY, by_recency=True)
    return rounded(df, *[f"d{i}_deliv_per" for i in range(1, 8)])


@query("a05_recent_dates", B.with_(B.BARS, B.HITS) + f" select distinct date from hits where date <= date '{TARGET_DAY}' order by date desc limit 2")
def a05(spark, sf):
    return SH.recent_dates(M.screener_hits(spark, sf), 2, TARGET_DAY)


# ---- market context -------------------------------------------------------------------

@query("a06_breadth_history", IND_SQL + " select date, round(avg(coalesce(close > sma50, false)::int), 6) as breadth, round(max(benchmark_ret_20d), 6) as bench20 from ind group by date")
def a06(spark, sf):
    return rounded(RS.breadth_history(indicators(spark, sf)), "breadth", "bench20")


@query("a06b_breadth_live", IND_SQL + " select date, round(avg((close > sma50)::int), 6) as breadth, count(sma50) as universe from ind group by date")
def a06b(spark, sf):
    return rounded(RS.breadth_live(indicators(spark, sf)), "breadth")


@query("a07_benchmark_drift", IND_SQL + " select date, round(any_value(benchmark_ret_20d), 6) as bench20 from ind where benchmark_ret_20d is not null group by date")
def a07(spark, sf):
    return rounded(RS.breadth_history(indicators(spark, sf)).select("date", "bench20").where(F.col("bench20").isNotNull()), "bench20")


STRENGTH = """
sector_day as (select i.date, s.sector, median(rs_vs_market) as sector_rs from ind i join sectors s on s.symbol = i.symbol
  where rs_vs_market is not null group by i.date, s.sector),
strength as (select *, (rank() over (partition by date order by sector_rs) + (count(*) over (partition by date, sector_rs) - 1) / 2.0)
  / count(*) over (partition by date) as sector_pct from sector_day)"""


@query("a08_sector_strength", B.with_(B.BARS, B.SECTORS, B.INDICATORS, STRENGTH) + f" select date, sector, {pick('sector_rs', 'sector_pct')} from strength")
def a08(spark, sf):
    return rounded(RS.sector_strength(indicators(spark, sf), M.sectors(spark, sf)), "sector_rs", "sector_pct")


# ---- evaluation -------------------------------------------------------------------------

LONG = "long_form as (" + " union all ".join(
    f"select date, symbol, sector, price, score, score_no_rs, rule_phase, {h} as h, upside_touched_{h}d as touched, future_max_{h}d as fmax "
    f"from gated where upside_touched_{h}d is not null" for h in HORIZONS) + ")"


@query("a09_decile_table", B.with_(SCORED, DECILES_SQL) + ", dl as (" + " union all ".join(
    f"select decile, {h} as horizon_days, upside_touched_{h}d as touched, future_max_{h}d as fmax from deciled where upside_touched_{h}d is not null" for h in HORIZONS)
    + ") select decile, horizon_days, count(*) as n, round(avg(touched), 6) as win_rate, round(avg(fmax), 6) as avg_future_max from dl group by decile, horizon_days")
def a09(spark, sf):
    return rounded(E.decile_table(gated(spark, sf)), "win_rate", "avg_future_max")


def precision_sql(k, score="score"):
    return f"""{LONG},
top as (select date, h, avg(touched) as p, count(*) as n_top from (select *, row_number() over (partition by date, h order by {score} desc, symbol) as rn from long_form)
  where rn <= {k} group by date, h),
basis as (select date, h, avg(touched) as b from long_form group by date, h),
per_day as (select t.date, t.h as horizon_days, {k} as k, t.p as precision_at_k, b.b as baseline_win_rate, t.n_top from top t join basis b on b.date = t.date and b.h = t.h)"""


_SUMMARY = """ round(avg(precision_at_k), 6) as avg_precision_at_k, round(avg(baseline_win_rate), 6) as avg_baseline_win_rate,
  count(*) as n_days, round(avg(precision_at_k) / nullif(avg(baseline_win_rate), 0), 6) as lift from per_day"""
_SUM_COLS = ["avg_precision_at_k", "avg_baseline_win_rate", "lift"]


@query("a10_precision_at_10", B.with_(SCORED, precision_sql(10)) + " select horizon_days," + _SUMMARY + " group by horizon_days")
def a10(spark, sf):
    g = stored(spark, sf, "date", "symbol", "score", *LABELS)
    return rounded(E.precision_at_k(g, 10), *_SUM_COLS)


@query("a10b_precision_by_day", B.with_(SCORED, precision_sql(25)) + f" select date, horizon_days, k, n_top, {pick('precision_at_k', 'baseline_win_rate')} from per_day")
def a10b(spark, sf):
    g = stored(spark, sf, "date", "symbol", "score", *LABELS)
    return rounded(E.precision_by_day(g, 25), "precision_at_k", "baseline_win_rate")


@query("a10c_precision_without_strength", B.with_(SCORED, precision_sql(10, "score_no_rs")) + " select horizon_days," + _SUMMARY + " group by horizon_days")
def a10c(spark, sf):
    g = stored(spark, sf, "date", "symbol", "score_no_rs", *LABELS)
    return rounded(E.precision_at_k(g, 10, "score_no_rs"), *_SUM_COLS)


TRADABLE = """
tradable as (select * from gated where tradable_win is not null),
tp as (select t.date, 10 as k, avg(tradable_win) filter (where rn <= 10) as precision_at_k, avg(tradable_win) as baseline_win_rate,
   count(*) filter (where rn <= 10) as n_top from (select *, row_number() over (partition by date order by score desc, symbol) as rn from tradable) t group by t.date)"""


@query("a11_precision_tradable", B.with_(SCORED, TRADABLE) + f" select date, k, n_top, {pick('precision_at_k', 'baseline_win_rate')} from tp")
def a11(spark, sf):
    g = stored(spark, sf, "date", "symbol", "score", "tradable_win")
    return rounded(E.precision_at_k_tradable(g, 10), "precision_at_k", "baseline_win_rate")


@query("a12_in_out_of_sample", B.with_(SCORED, precision_sql(10)) + """, ds as (select list_sort(list(distinct date)) as d from gated),
  cut as (select d[cast(floor(len(d) * 0.7::double) as int) + 1] as c from ds)
  select case when date <= (select c from cut) then 'in_sample' else 'out_of_sample' end as split, horizon_days,""" + _SUMMARY + " group by split, horizon_days")
def a12(spark, sf):
    g = stored(spark, sf, "date", "symbol", "score", *LABELS)
    return rounded(E.split_precision(g, 10), *_SUM_COLS)


@query("a13_rule_phase_table", B.with_(SCORED, LONG) + """ select rule_phase, h as horizon_days, count(*) as samples, round(avg(touched), 6) as win_rate,
  round(avg(fmax), 6) as avg_future_max from long_form group by rule_phase, h""")
def a13(spark, sf):
    return rounded(E.rule_phase_table(gated(spark, sf)), "win_rate", "avg_future_max")


@query("a14_sector_table", B.with_(SCORED, LONG) + """ select sector, count(*) as n, round(avg(touched), 6) as win_rate, round(avg(price), 6) as avg_price from (
  select *, row_number() over (partition by date order by score desc, symbol) as rn from long_form where h = 15) where rn <= 25 group by sector""")
def a14(spark, sf):
    return rounded(E.sector_table(gated(spark, sf)), "win_rate", "avg_price")


def grid_sql(cells):
    values = ", ".join(f"({tp}::double, {sl}::double, {h})" for tp, sl, h in cells)
    return f"""
picks as (select symbol, date from (select *, row_number() over (partition by date order by score desc, symbol) as rn from gated where score is not null) where rn <= 10),
gp_seg0 as (select symbol, date, price, lag(date) over (partition by symbol order by date) as pd from gated),
gp_seg as (select symbol, date, price, cast(sum(case when date - pd > 5 then 1 else 0 end) over (partition by symbol order by date) as int) as seg from gp_seg0),
{B.path_cte('lab_seg', 'price', 30, 'symbol, seg', 100, 100, 'gp')},
grid(tp, sl, h) as (values {values}),
outcomes as (
  select p.symbol, p.date, g.tp, g.sl, g.h, min(k) filter (where r <= -g.sl or r >= g.tp) as hk, arg_min(r, k) filter (where r <= -g.sl or r >= g.tp) as hit,
    arg_max(r, k) as last, max(k) as nk from picks p join gp on gp.symbol = p.symbol and gp.date = p.date join grid g on gp.k <= g.h group by p.symbol, p.date, g.tp, g.sl, g.h),
resolved_trades as (select tp, sl, h, case when hit <= -sl then -sl when hit >= tp then tp else last end as ret, coalesce(hk, nk) as hold,
    case when hit <= -sl then 'stop' when hit >= tp then 'win' else 'timeout' end as kind from outcomes),
cells as (
  select tp, sl, h::int as h, count(*) as n, avg((kind = 'win')::int) * 100 as win_pct, avg((kind = 'stop')::int) * 100 as stop_pct, avg((kind = 'timeout')::int) * 100 as timeout_pct,
    avg(ret) as avg_ret, median(ret) as median_ret, avg(hold) as avg_hold, avg(ret) / avg(hold) as ret_per_session,
    case when -sum(case when ret < 0 then ret else 0 end) > 0 then sum(case when ret > 0 then ret else 0 end) / -sum(case when ret < 0 then ret else 0 end)
         else 'inf'::double end as profit_factor from resolved_trades group by tp, sl, h)"""


_CELL = ["win_pct", "stop_pct", "timeout_pct", "avg_ret", "median_ret", "avg_hold", "ret_per_session", "profit_factor"]
_FEW = [(20, 8, 30), (25, 5, 30), (30, 5, 10), (5, 8, 30)]


def _paths(spark, sf):
    panel = cut_lineage(labeled(spark, sf).select("symbol", "date", "price", "score", "volume", "sector"), "labeled")
    from ..plans.scorecard import backtest_gate
    return E.pick_paths(E.daily_picks(backtest_gate(panel, t=T), 10), panel, t=T)


@query("a15_trade_evaluation", B.with_(SCORED, grid_sql(_FEW)) + f" select tp, sl, h, n, {pick(*_CELL)} from cells")
def a15(spark, sf):
    return rounded(E.trade_grid(_paths(spark, sf), _FEW), *_CELL)


_SEARCH = grid_sql(E.search_cells()) + """,
best_tp as (select arg_max(tp, avg_ret) as tp from cells where sl = 8 and h = 30 and tp in (5, 8, 10, 12, 15, 18, 20, 25, 30, 40)),
search as (
  select 'target' as sweep, * from cells where sl = 8 and h = 30 and tp in (5, 8, 10, 12, 15, 18, 20, 25, 30, 40)
  union all select 'stop', * from cells where tp = (select tp from best_tp) and h = 30 and sl in (5, 6, 8, 10, 12)
  union all select 'horizon', * from cells where tp = (select tp from best_tp) and sl = 8 and h in (10, 15, 20, 30)
  union all select 'joint', * from cells where tp in (20, 25, 30) and sl in (5, 6, 8) and h in (10, 15, 30))"""


@query("a16_parameter_search", B.with_(SCORED, _SEARCH) + f" select sweep, tp, sl, h, n, {pick(*_CELL)} from search")
def a16(spark, sf):
    return rounded(E.parameter_search(_paths(spark, sf), t=T), *_CELL)


@query("a16b_best_cells", B.with_(SCORED, _SEARCH) + """ select choice, tp, sl, h, n, round(win_pct, 6) as win_pct, round(avg_ret, 6) as avg_ret,
    round(ret_per_session, 6) as ret_per_session, round(avg_hold, 6) as avg_hold, round(profit_factor, 6) as profit_factor from (
  select *, row_number() over (partition by choice order by m desc, tp, sl, h) as rn from (
    select 'target_by_return' as choice, avg_ret as m, * from search where sweep = 'target'
    union all select 'target_by_session', ret_per_session, * from search where sweep = 'target'
    union all select 'joint_by_return', avg_ret, * from search where sweep = 'joint')) where rn = 1""")
def a16b(spark, sf):
    best = E.best_cells(cut_lineage(E.parameter_search(_paths(spark, sf), t=T), "search"))
    return rounded(best, "win_pct", "avg_ret", "ret_per_session", "avg_hold", "profit_factor")


# ---- feature tests -------------------------------------------------------------------

RESOLVED = """
resolved as (select *, tradable_win::int as win, coalesce(upside_touched_20d, 0) as touch,
  row_number() over (partition by date order by score desc, symbol) as rank from labeled where tradable_win in (0, 1)),
short as (select * from resolved where rank <= 40)"""
FEATURES = RESOLVED + "," + STRENGTH + """,
breadth as (select date, avg(coalesce(close > sma50, false)::int) as breadth, max(benchmark_ret_20d) as bench20 from ind group by date),
deliv as (select symbol, date, range_contraction_ratio, deliv_per / nullif(case when count(deliv_per) over w >= 5 then avg(deliv_per) over w end, 0) as deliv_ratio from ind
  window w as (partition by symbol order by date rows between 19 preceding and current row)),
feat as (select r.*, d.deliv_ratio, d.range_contraction_ratio as rcr, s.sector_pct, b.breadth, b.bench20 from resolved r
  left join deliv d on d.symbol = r.symbol and d.date = r.date left join strength s on s.date = r.date and s.sector = r.sector
  left join breadth b on b.date = r.date),
tests as (
  select 'F1 breadth' as test, coalesce(breadth > (select median(breadth) from feat), false) as pos, win, touch from feat where rank <= 10
  union all select 'F1b benchmark trend', coalesce(bench20 > 0, false), win, touch from feat where rank <= 10
  union all select 'F2 sector strength', coalesce(sector_pct >= 0.75, false), win, touch from feat where rank <= 40
  union all select 'F3 delivery trend', coalesce(deliv_ratio >= 1.3, false), win, touch from feat where rank <= 40
  union all select 'F4 squeeze', coalesce(rcr <= (select quantile_cont(rcr, 0.33) from feat where rank <= 40), false), win, touch from feat where rank <= 40),
tested as (select test, count(*) filter (where pos) as pos_n, count(*) filter (where not pos) as neg_n, avg(win) filter (where pos) * 100 as pos_win,
   avg(win) filter (where not pos) * 100 as neg_win, avg(touch) filter (where pos) * 100 as pos_touch, avg(touch) filter (where not pos) * 100 as neg_touch,
   avg(win) * 100 as base_win from tests group by test)"""


@query("a17_split_tests", B.with_(SCORED, FEATURES) + f""" select test, pos_n, neg_n, {pick('pos_win', 'neg_win', 'pos_touch', 'neg_touch', 'base_win')}, round(pos_win - neg_win, 6) as edge,
  case when pos_n < 40 or neg_n < 40 then 'n/a' when pos_win - neg_win >= 4 and pos_win > base_win then 'EDGE' when pos_win - neg_win >= 1.5 then 'weak' else 'none' end as verdict from tested""")
def a17(spark, sf):
    ind = stored_indicators(spark, sf, "close", "sma50", "deliv_per", "range_contraction_ratio", "benchmark_ret_20d", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans.scorecard import labeled_history
    from .frames import sheet
    panel = labeled_history(sheet(spark, sf), ind, t=T)
    features = cut_lineage(RS.feature_frame(panel, ind, M.sectors(spark, sf)), "features")
    return rounded(RS.feature_tests(features), "pos_win", "neg_win", "pos_touch", "neg_touch", "base_win", "edge")


@query("a18_feature_frame", B.with_(SCORED, FEATURES) + f" select symbol, date, {pick('deliv_ratio', 'sector_pct', 'breadth', 'bench20')} from feat")
def a18(spark, sf):
    ind = stored_indicators(spark, sf, "close", "sma50", "deliv_per", "range_contraction_ratio", "benchmark_ret_20d", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans.scorecard import labeled_history
    from .frames import sheet
    f = RS.resolved(RS.feature_frame(labeled_history(sheet(spark, sf), ind, t=T), ind, M.sectors(spark, sf)))
    cols = ["deliv_ratio", "sector_pct", "breadth", "bench20"]
    return rounded(f.select("symbol", "date", *cols), *cols)


_BY_SCREENER = """, by_screener as (select screener, count(*) as n, sum(win)::bigint as wins from (select win, unnest(screeners) as screener from short) group by screener)"""
_BY_NORM = f""", exploded as (select date, win, {B.NORM.format('s')} as screener from (select date, win, unnest(screeners) as s from short))"""


def _short(spark, sf, k=40):
    return RS.ranked_shortlist(labeled(spark, sf).select("symbol", "date", "score", "screeners", "tradable_win", "upside_touched_20d"), k)


@query("a19_screener_win_rates", B.with_(SCORED, RESOLVED) + _BY_SCREENER + " select screener, n, wins, round(wins / n * 100, 6) as win_rate from by_screener where n >= 60")
def a19(spark, sf):
    return rounded(RS.screener_win_rates(_short(spark, sf)), "win_rate")


@query("a19b_screener_spread", B.with_(SCORED, RESOLVED) + _BY_SCREENER + """, r as (select wins / n * 100 as wr from by_screener where n >= 60)
  select count(*) as screeners, round(max(wr), 6) as best, round(min(wr), 6) as worst, round(max(wr) - min(wr), 6) as spread,
    case when max(wr) - min(wr) >= 8 then 'EDGE' else 'weak' end as verdict from r""")
def a19b(spark, sf):
    return rounded(RS.screener_spread(RS.screener_win_rates(_short(spark, sf))), "best", "worst", "spread")


@query("a20_weight_generation", B.with_(SCORED, RESOLVED) + _BY_NORM + """ select screener, round_even(sum(win) / count(*) * 100, 1) as win_rate, count(*) as n,
  case when count(*) >= 120 then least(greatest(round_even((sum(win) / count(*) * 100 - 8) * 0.9::double, 0)::int, 0), 12) else 3 end as weight from exploded group by screener having count(*) >= 30""")
def a20(spark, sf):
    return RS.screener_weights(_short(spark, sf), t=T)


@query("a21_split_half_stability", B.with_(SCORED, RESOLVED) + _BY_NORM + """,
  cut as (select quantile_cont(date - date '1970-01-01', 0.5) as c from short),
  halves as (select screener, case when date - date '1970-01-01' <= (select c from cut) then 'a' else 'b' end as half, win from exploded),
  rates as (select screener, half, sum(win) / count(*) * 100 as wr from halves group by screener, half having count(*) >= 30),
  pairs as (select a.screener, a.wr as x, b.wr as y from rates a join rates b on a.screener = b.screener and a.half = 'a' and b.half = 'b'),
  ranks as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from pairs)
  select count(*) as common, round(case when count(*) >= 8 then corr(rx, ry) end, 6) as rank_corr,
    case when count(*) < 8 or corr(rx, ry) is null then 'n/a' when corr(rx, ry) >= 0.35 then 'STABLE' else 'UNSTABLE' end as verdict from ranks""")
def a21(spark, sf):
    return rounded(RS.split_half_stability(cut_lineage(_short(spark, sf), "shortlist")), "rank_corr")


_OUT = ["win_pct", "mean_peak_pct"]


@query("a22_pivot_follow_through", B.with_(B.BARS, B.INDICATORS, GAPS, FIXED_SQL) + """, ep as (select g.close_pos, f.tpsl, f.fwd_max20 from gaps g join fixed f
     on f.symbol = g.symbol and f.date = g.date where ep_raw and tpsl is not null),
  c as (select 'all' as cohort, * from ep union all select 'held', * from ep where close_pos >= 0.5 union all select 'faded', * from ep where close_pos < 0.5)
  select cohort, count(*) as n, round(avg(tpsl) * 100, 6) as win_pct, round(avg(fwd_max20) * 100, 6) as mean_peak_pct from c group by cohort""")
def a22(spark, sf):
    return rounded(RS.pivot_follow_through(indicators(spark, sf), t=T), *_OUT)


def mention_sql(per_symbol, room=None):
    cut = f"where m.date <= (select max(date) - {room} from bars)" if room else ""
    match = "b.symbol = h.symbol and b.date >= h.date" if per_symbol else "b.date >= h.date"
    source = "bars" if per_symbol else "(select distinct date from bars)"
    return f"""{B.MESSAGES.strip()},
hits_m as (select m.message_id, m.date, regexp_full_match(sender, '-?[0-9]+') as admin, regexp_extract(text, '(SYM[A-Z])', 1) as symbol from messages m {cut}),
asked as (select distinct symbol, date from hits_m),
placed as (select h.symbol, h.date as said, min(b.date) as date from asked h join {source} b on {match} group by h.symbol, h.date),
mo as (select h.admin, f.tpsl, f.fwd_max20 from hits_m h join placed p on p.symbol = h.symbol and p.said = h.date
  join fixed f on f.symbol = h.symbol and f.date = p.date where f.fwd_max20 is not null),
mc as (select 'all' as cohort, * from mo union all select case when admin then 'admin' else 'member' end, * from mo)"""


_MENTION_OUT = " select cohort, count(*) as n, round(avg(tpsl) * 100, 6) as win_pct, round(avg(fwd_max20) * 100, 6) as mean_peak_pct from mc group by cohort"


@query("a23_mention_precedence", B.with_(B.BARS, FIXED_SQL, mention_sql(False)) + _MENTION_OUT)
def a23(spark, sf):
    return rounded(RS.mention_precedence(M.messages(spark, sf), M.listed_companies(spark, sf), M.bars(spark, sf), per_symbol=False), *_OUT)


@query("a23b_mention_precedence_own_bars", B.with_(B.BARS, FIXED_SQL, mention_sql(True, 35)) + _MENTION_OUT)
def a23b(spark, sf):
    return rounded(RS.mention_precedence(
        M.messages(spark, sf), M.listed_companies(spark, sf), M.bars(spark, sf), forward_room_days=35), *_OUT)


DESKS = ["Supplier#00000000", "R#000000011"]


@query("a24_deal_precedence", B.with_(B.BARS, B.DEALS, FIXED_SQL) + """, fb as (select symbol, date from deals where side = 'BUY'
     and not (upper(client) like '%SUPPLIER#00000000%' or upper(client) like '%R#000000011%')),
  ad as (select distinct symbol, date from fb), pl as (select a.symbol, a.date as dealt, min(b.date) as date from ad a join (select distinct date from bars) b on b.date >= a.date group by a.symbol, a.date)
  select 'fund buys' as cohort, count(*) as n, round(avg(tpsl) * 100, 6) as win_pct, round(avg(fwd_max20) * 100, 6) as mean_peak_pct
  from fb join pl on pl.symbol = fb.symbol and pl.dealt = fb.date join fixed f on f.symbol = fb.symbol and f.date = pl.date where fwd_max20 is not null""")
def a24(spark, sf):
    desks = [d.upper() for d in DESKS]
    return rounded(RS.deal_precedence(M.deals(spark, sf), M.bars(spark, sf), desks), *_OUT)


EXIT_SQL = B.path_cte("bars", "close", 40, "symbol", None, 1, "xp") + """,
top10 as (select symbol, date from (select *, row_number() over (partition by date order by score desc, symbol) as rn from labeled where score is not null) where rn <= 10),
xl as (select t.symbol, t.date, coalesce(i.atr_pct / 100.0, 0.05) as atr, list(r order by k) as p from top10 t join xp on xp.symbol = t.symbol and xp.date = t.date
  join ind i on i.symbol = t.symbol and i.date = t.date group by t.symbol, t.date, i.atr_pct having count(*) >= 2),
xr as (
  select symbol, date, p, p[len(p)] as last,
    list_filter(p, lambda x: x <= -0.05 or x >= 0.25)[1] as ha, list_filter(p[1:10], lambda x: x <= -0.05 or x >= 0.30)[1] as hb, p[least(len(p), 10)] as lastb,
    list_reduce(list_concat([{'x': 0.0::double, 'peak': 0.0::double, 'stop': -1.5 * atr, 'out': null::double}], list_transform(p, lambda x: {'x': x, 'peak': 0.0::double, 'stop': 0.0::double, 'out': null::double})),
      lambda a, b: {'x': b.x, 'peak': greatest(a.peak, b.x), 'stop': greatest(a.stop, greatest(a.peak, b.x) - 3 * atr), 'out': case when a.out is not null then a.out
        when b.x <= greatest(a.stop, greatest(a.peak, b.x) - 3 * atr) then b.x when b.x >= 0.40 then 0.40::double end}) as rc,
    list_reduce(list_concat([{'x': 0.0::double, 'stop': -0.06::double, 'out': null::double}], list_transform(p, lambda x: {'x': x, 'stop': 0.0::double, 'out': null::double})),
      lambda a, b: {'x': b.x, 'stop': case when b.x >= 0.08 then 0.0::double else a.stop end, 'out': case when a.out is not null then a.out
        when b.x <= case when b.x >= 0.08 then 0.0::double else a.stop end then case when b.x >= 0.08 then 0.0::double else a.stop end when b.x >= 0.35 then 0.35::double end}) as rd,
    list_reduce(list_concat([{'x': 0.0::double, 'peak': 0.0::double, 'stop': -0.06::double, 'half': false, 'out': null::double}],
        list_transform(p, lambda x: {'x': x, 'peak': 0.0::double, 'stop': 0.0::double, 'half': false, 'out': null::double})),
      lambda a, b: case when a.out is not null then a else {'x': b.x, 'peak': greatest(a.peak, b.x), 'stop': greatest(a.stop, greatest(a.peak, b.x) - 3 * atr), 'half': a.half or b.x >= 0.15,
        'out': case when b.x <= greatest(a.stop, greatest(a.peak, b.x) - 3 * atr) then b.x end} end) as re
  from xl),
runs as (
  select symbol, date, 'A' as rule, case when ha <= -0.05 then -0.05 when ha >= 0.25 then 0.25 else last end as ret from xr
  union all select symbol, date, 'B', case when hb <= -0.05 then -0.05 when hb >= 0.30 then 0.30 else lastb end from xr
  union all select symbol, date, 'C', coalesce(rc.out, last) from xr
  union all select symbol, date, 'D', coalesce(rd.out, last) from xr
  union all select symbol, date, 'E', case when re.half then (coalesce(re.out, last) + 0.15) / 2 else coalesce(re.out, last) end from xr)"""


@query("w21_exit_simulation", B.with_(SCORED, EXIT_SQL) + " select symbol, date, rule, round(ret, 6) as ret from runs")
def w21(spark, sf):
    ind = stored_indicators(spark, sf, "close", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans.scorecard import score_history
    from .frames import sheet
    picks = E.daily_picks(score_history(sheet(spark, sf), ind, t=T), 10)
    return rounded(exit_simulation(picks, ind, t=T), "ret")


@query("a25_exit_rule_table", B.with_(SCORED, EXIT_SQL) + """, st as (select rule, count(*) as n, avg(ret * 100) as expectancy, avg((ret > 0)::int) * 100 as win_pct,
    coalesce(avg(ret * 100) filter (where ret > 0), 0) as avg_win, coalesce(avg(ret * 100) filter (where ret <= 0), 0) as avg_loss from runs group by rule)
  select rule, n, round(expectancy, 6) as expectancy, round(win_pct, 6) as win_pct, round(avg_win, 6) as avg_win, round(avg_loss, 6) as avg_loss,
    round(expectancy - (select expectancy from st where rule = 'A'), 6) as delta_vs_fixed from st""")
def a25(spark, sf):
    ind = stored_indicators(spark, sf, "close", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans.scorecard import score_history
    from .frames import sheet
    table = RS.exit_rule_table(score_history(sheet(spark, sf), ind, t=T), ind, t=T).drop("name")
    return rounded(table, "expectancy", "win_pct", "avg_win", "avg_loss", "delta_vs_fixed")


@query("a35_base_rates", B.with_(SCORED, RESOLVED) + """, sc as (select 'all' as scope, win, touch from resolved union all select 'top40', win, touch from short
   union all select 'top10', win, touch from short where rank <= 10)
  select scope, count(*) as n, round(avg(win) * 100, 6) as win_pct, round(avg(touch) * 100, 6) as touch_pct from sc group by scope""")
def a35(spark, sf):
    g = stored(spark, sf, "symbol", "date", "score", "tradable_win", "upside_touched_20d", gate=False)
    return rounded(RS.base_rates(g), "win_pct", "touch_pct")


@query("a36_quality_rates", IND_SQL + " select round(avg((bars_since_gap >= 200)::int), 6) as trusted_200_share, round(avg(trend_template_pass::int), 6) as template_pass_rate from ind")
def a36(spark, sf):
    return rounded(E.quality_rates(indicators(spark, sf)), "trusted_200_share", "template_pass_rate")


_VALIDATE = "vl as (" + " union all ".join(
    f"select 'structure' as ranking, g.date, g.symbol, {h} as h, g.upside_touched_{h}d as touched, coalesce(i.trend_template_pass, false)::int * 10 + coalesce(i.range_contraction_ratio < 0.7, false)::int * 5 "
    f"+ coalesce(least(i.rel_volume, 5.0), 0) as s from gated g join ind i on i.symbol = g.symbol and i.date = g.date where g.upside_touched_{h}d is not null"
    f" union all select 'relative_strength', g.date, g.symbol, {h}, g.upside_touched_{h}d, i.rs_vs_market from gated g join ind i on i.symbol = g.symbol and i.date = g.date "
    f"where g.upside_touched_{h}d is not null and i.rs_vs_market is not null" for h in HORIZONS) + """),
vd as (select ranking, date, h, avg(touched) filter (where rn <= 10) as precision_at_k, avg(touched) as baseline_win_rate from (
   select *, row_number() over (partition by ranking, date, h order by s desc, symbol) as rn from vl) group by ranking, date, h)"""


@query("a37_validate_rankings", B.with_(SCORED, _VALIDATE) + " select ranking, h as horizon_days," + _SUMMARY.replace("per_day", "vd") + " group by ranking, h")
def a37(spark, sf):
    ind = stored_indicators(spark, sf, "trend_template_pass", "range_contraction_ratio", "rel_volume", "rs_vs_market")
    g = stored(spark, sf, "symbol", "date", *LABELS)
    return rounded(E.validate_rankings(g, ind), *_SUM_COLS)


@query("a38_panel_profile", B.with_(B.BARS) + " select count(*) as rows, count(distinct symbol) as symbols, count(distinct date) as dates, min(date) as first_date, max(date) as last_date from bars")
def a38(spark, sf):
    return E.profile(M.bars(spark, sf))


@query("w24b_gap_features", B.with_(B.BARS, B.INDICATORS, GAPS) + " select date, count(*) filter (where ep_raw) as pivots from gaps group by date")
def w24b(spark, sf):
    return add_gap_features(indicators(spark, sf), t=T).groupBy("date").agg(F.count_if("ep_raw").alias("pivots"))
