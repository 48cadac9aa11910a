"""Joins, as-of maps and calendar (J, D and remaining W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as C
from ..operators import sheets as SH
from ..operators import text as X
from ..operators.asof import bars_before_map, next_bar_map, next_session, session_calendar
from ..operators.labels import add_labels
from ..operators.timeseries import by_symbol, benchmark_returns, post_signal_stats
from ..plans import evaluation as E
from ..plans import research as RS
from ..plans import triage as TR
from ..sources import files as FI
from ..sources import market_tables as M
from . import blocks as B
from .evaluation_q import STRENGTH, TARGET_DAY, grid_sql, _avgs, _pivot
from .frames import T, indicators, sheet
from .registry import query
from .scoring_q import LIVE_SQL, candidates
from .windows_q import AS_OF, IND_SQL, SHEET_DAY, pick, rounded

DAY = TARGET_DAY
PREV = "(select max(date) from hits where date < date '" + DAY + "')"


def _merged(spark, sf):
    q = M.bars(spark, sf).withColumn(
        "chg", (F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1) * 100
    ).select("symbol", "date", F.col("close").alias("price"), "chg", F.col("volume").cast("double").alias("volume"))
    return SH.merge_hits(M.screener_hits(spark, sf).join(q, ["symbol", "date"]), ("symbol", "date"))


def _two_days(spark, sf):
    m = _merged(spark, sf)
    dates = [r.date for r in SH.recent_dates(M.screener_hits(spark, sf), 2, DAY).collect()]
    return SH.compare_with_previous(FI.on_date(m, dates[0]).drop("date"), FI.on_date(m, dates[1]).drop("date"))


_COMPARED = B.with_(B.SHEET) + f""", today as (select * from sheet where date = date '{DAY}'),
yest as (select * from sheet where date = {PREV}),
cmp as (select t.symbol, t.price, t.chg, t.volume, t.today_count, t.count_diff, t.new_screeners, t.screeners, t.sector, y.symbol is not null as was_in_previous_sheet,
   round(t.chg - y.chg, 2) as chg_wrt_previous from today t left join yest y on y.symbol = t.symbol)"""


@query("j01_today_vs_previous", _COMPARED + """ select symbol, round(chg, 6) as chg, today_count::int as today_count, count_diff::int as count_diff,
  array_to_string(new_screeners, ',') as new_screeners, was_in_previous_sheet, chg_wrt_previous from cmp""")
def j01(spark, sf):
    c = _two_days(spark, sf)
    return c.select("symbol", F.round("chg", 6).alias("chg"), "today_count", "count_diff",
                    F.array_join("new_screeners", ",").alias("new_screeners"), "was_in_previous_sheet", "chg_wrt_previous")


def _daily_parts(spark, sf):
    b = M.bars(spark, sf)
    day = FI.on_date(M.deals(spark, sf), DAY)
    delivery = SH.delivery_averages(b, DAY).join(SH.delivery_pivot(b, DAY, by_recency=True), "symbol", "left")
    bulk = SH.deals_summary(day.where(F.col("kind") == "bulk"), prefix="bulk_")
    block = SH.deals_summary(day.where(F.col("kind") == "block"), prefix="block_")
    return _two_days(spark, sf), delivery.withColumnsRenamed({"deliv_qty": "d_qty", "deliv_per": "d_per"}), bulk, block


_ASSEMBLED = _COMPARED + f""", da as (select symbol, arg_max(deliv_qty, date) as d_qty, {_avgs} from (select *, row_number() over (partition by symbol order by date desc) as rn
    from bars where date <= date '{DAY}') where rn <= 10 group by symbol having max(date) = date '{DAY}'),
dr as (select date, row_number() over (order by date desc) as dr from (select distinct date from bars where date <= date '{DAY}')),
dp as (select symbol, {_pivot} from bars b join dr on dr.date = b.date where dr.dr <= 7 group by symbol),
bk as (select symbol, kind, sum(case when side = 'BUY' then quantity else 0.0 end) as bq, sum(case when side = 'SELL' then quantity else 0.0 end) as sq,
   count(*) filter (where side = 'BUY') as bc from deals where date = date '{DAY}' group by symbol, kind),
full_sheet as (select * from (select cmp.*, cmp.symbol as s1 from cmp) c full join (select da.*, dp.d1_deliv_qty, dp.d7_deliv_qty from da left join dp on dp.symbol = da.symbol) d using (symbol)
   full join (select symbol, bq as bulk_buy, sq as bulk_sell, bc as bulk_count from bk where kind = 'bulk') u using (symbol)
   full join (select symbol, bq as block_buy, sq as block_sell from bk where kind = 'block') k using (symbol))"""


@query("j02_sheet_assembly", _ASSEMBLED + """ select symbol, price, d_qty, avg3_deliv_qty, avg10_deliv_per, bulk_buy, bulk_sell, bulk_count, block_buy, block_sell from full_sheet""")
def j02(spark, sf):
    s = SH.assemble_sheet(*_daily_parts(spark, sf), None)
    return rounded(s.select(
        "symbol", "price", "d_qty", "avg3_deliv_qty", "avg10_deliv_per", F.col("bulk_buy_quantity").alias("bulk_buy"),
        F.col("bulk_sell_quantity").alias("bulk_sell"), F.col("bulk_buy_count").alias("bulk_count"),
        F.col("block_buy_quantity").alias("block_buy"), F.col("block_sell_quantity").alias("block_sell")), "avg3_deliv_qty", "avg10_deliv_per")


@query("j03_delivery_with_pivot", _ASSEMBLED + " select da.symbol, da.d_qty, dp.d1_deliv_qty, dp.d7_deliv_qty from da left join dp on dp.symbol = da.symbol")
def j03(spark, sf):
    return _daily_parts(spark, sf)[1].select("symbol", "d_qty", "d1_deliv_qty", "d7_deliv_qty")


@query("j04_sector_attach", _ASSEMBLED + " select f.symbol, f.price, s.sector from full_sheet f join sectors s on s.symbol = f.symbol where f.chg is not null and s.sector <> 'SEC4'")
def j04(spark, sf):
    mapped = M.sectors(spark, sf).where(F.col("sector") != "SEC4")
    return SH.attach_sectors(SH.assemble_sheet(*_daily_parts(spark, sf)), mapped).select("symbol", "price", "sector")


@query("j05_benchmark_join", IND_SQL + """ select i.date, count(*) as n, count(benchmark_ret_20d) as matched, round(any_value(benchmark_ret_20d), 6) as benchmark_ret_20d from ind i group by i.date""")
def j05(spark, sf):
    ind = indicators(spark, sf)
    out = ind.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count("benchmark_ret_20d").alias("matched"),
                                  F.max("benchmark_ret_20d").alias("benchmark_ret_20d"))
    return rounded(out, "benchmark_ret_20d")


@query("j06_labels_with_indicators", B.with_(B.SHEET, B.INDICATORS, B.LABELS) + f""" select s.symbol, s.date, l.tradable_win, {pick('rs_vs_market', 'rel_volume')}
  from sheet s left join lab l on l.symbol = s.symbol and l.date = s.date left join ind i on i.symbol = s.symbol and i.date = s.date and i.rel_volume is not null""")
def j06(spark, sf):
    lab = add_labels(sheet(spark, sf).select("symbol", "date", "price"), t=T).select("symbol", "date", "tradable_win")
    ind = indicators(spark, sf).where(F.col("rel_volume").isNotNull()).select("symbol", "date", "rs_vs_market", "rel_volume")
    return rounded(lab.join(ind, ["symbol", "date"], "left"), "rs_vs_market", "rel_volume")


@query("j07_labels_inner_indicators", B.with_(B.SHEET, B.INDICATORS, B.LABELS) + f""" select s.symbol, s.date, l.tradable_win, {pick('i.rel_volume').replace('as i.', 'as ')}
  from sheet s left join lab l on l.symbol = s.symbol and l.date = s.date join ind i on i.symbol = s.symbol and i.date = s.date and i.rel_volume is not null""")
def j07(spark, sf):
    lab = add_labels(sheet(spark, sf).select("symbol", "date", "price"), t=T).withColumn("rel_volume", F.lit(-1.0))
    ind = indicators(spark, sf).where(F.col("rel_volume").isNotNull()).select("symbol", "date", "rel_volume")
    # Overlapping columns come from the indicator side.
    overlap = [c for c in ind.columns if c in lab.columns and c not in ("symbol", "date")]
    return rounded(lab.drop(*overlap).join(ind, ["symbol", "date"]).select("symbol", "date", "tradable_win", "rel_volume"), "rel_volume")


@query("j09_sector_day_metrics", B.with_(B.BARS, B.SECTORS, B.INDICATORS, STRENGTH) + f""" select b.symbol, b.date, s.sector, {pick('sector_pct')} from bars b
  left join sectors s on s.symbol = b.symbol left join strength t on t.date = b.date and t.sector = s.sector""")
def j09(spark, sf):
    sec = M.sectors(spark, sf)
    pct = RS.sector_strength(indicators(spark, sf), sec).select("date", "sector", "sector_pct")
    out = M.bars(spark, sf).select("symbol", "date").join(sec, "symbol", "left").join(pct, ["date", "sector"], "left")
    return rounded(out, "sector_pct")


@query("j10_market_day_metrics", IND_SQL + """, d as (select date, avg(coalesce(close > sma50, false)::int) as breadth from ind group by date)
  select i.symbol, i.date, round(d.breadth, 6) as breadth from ind i left join d on d.date = i.date""")
def j10(spark, sf):
    ind = indicators(spark, sf).select("symbol", "date", "close", "sma50", "benchmark_ret_20d")
    day = RS.breadth_history(ind).select("date", "breadth")      # one row per calendar date
    return rounded(ind.select("symbol", "date").join(day, "date", "left"), "breadth")


@query("j11_next_market_session", B.with_(B.BARS, B.MESSAGES) + """, d as (select distinct date from bars), a as (select distinct date as said from messages)
  select m.message_id, m.date as said, p.date from messages m left join (select said, min(d.date) as date from a join d on d.date >= said group by said) p on p.said = m.date""")
def j11(spark, sf):
    m = M.messages(spark, sf).select("message_id", F.col("date").alias("said"))
    return next_session(m, M.bars(spark, sf), "said")


@query("j12_next_own_bar", B.with_(B.BARS, B.DEALS) + """, a as (select distinct symbol, date + 3 as dealt from deals)
  select a.symbol, a.dealt, min(b.date) as date from a left join bars b on b.symbol = a.symbol and b.date >= a.dealt group by a.symbol, a.dealt""")
def j12(spark, sf):
    events = M.deals(spark, sf).select("symbol", F.date_add("date", 3).alias("dealt"))
    return next_bar_map(events, M.bars(spark, sf), "dealt")


@query("j12b_bars_before", B.with_(B.BARS, B.DEALS) + """, a as (select distinct symbol, date + 3 as dealt from deals)
  select a.symbol, a.dealt, count(b.date) as bars_before from a left join bars b on b.symbol = a.symbol and b.date <= a.dealt group by a.symbol, a.dealt""")
def j12b(spark, sf):
    events = M.deals(spark, sf).select("symbol", F.date_add("date", 3).alias("dealt"))
    return bars_before_map(events, M.bars(spark, sf), "dealt")


@query("j13_post_signal_slice", B.with_(B.BARS) + f" select symbol, count(*) as n, min(date) as first_date, max(close) as peak from bars where date >= date '{AS_OF}' group by symbol")
def j13(spark, sf):
    b = M.bars(spark, sf).where(F.col("date") >= F.lit(AS_OF).cast("date"))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("close").alias("peak"))


@query("j14_trailing_days_slice", B.with_(B.MESSAGES) + f" select message_id, date, sender from messages where date between date '{AS_OF}' - 45 and date '{AS_OF}'")
def j14(spark, sf):
    return X.recent_messages(M.messages(spark, sf), AS_OF, 45).select("message_id", "date", "sender")


@query("j16_missing_weekdays", B.with_(B.BARS) + """, lim as (select min(date) as a, max(date) as b from bars where volume >= 300000)
  select g::date as date from (select unnest(generate_series(a, b, interval 1 day)) as g from lim) where isodow(g) <= 5
    and g::date not in (select date from bars where volume >= 300000)""")
def j16(spark, sf):
    return C.missing_weekdays(M.bars(spark, sf).where(F.col("volume") >= 300_000))


@query("j17_sheet_diff", LIVE_SQL + f""", d1 as (select max(date) as d from live where date <= date '{SHEET_DAY}'), d0 as (select max(date) as d from live where date < (select d from d1)),
  a as (select * from live where date = (select d from d1) and rank <= 60), p as (select * from live where date = (select d from d0))
  select coalesce(a.symbol, p.symbol) as symbol, case when p.symbol is null then 'new' when a.symbol is null then 'dropped' else 'kept' end as state,
    p.rank - a.rank as rank_delta, a.score - p.score as score_delta from a full join p on p.symbol = a.symbol""")
def j17(spark, sf):
    today, before = _last_two_sheets(spark, sf)
    return TR.sheet_diff(today.where(F.col("rank") <= T.triage_rows), before).select("symbol", "state", "rank_delta", "score_delta")


def _last_two_sheets(spark, sf):
    from ..session import cut_lineage
    ranked = candidates(spark, sf).where(F.col("date") <= F.lit(SHEET_DAY).cast("date"))
    c = cut_lineage(ranked, "candidates")
    today = FI.latest_rows(c)
    newest = c.agg(F.max("date")).first()[0]
    return today, FI.latest_rows(c, before=newest)


@query("j18_ticker_dictionary_join", B.with_(B.MESSAGES, B.LISTED) + """ select l.symbol, count(*) as n from messages m
  join listed l on l.symbol = regexp_extract(m.text, '(SYM[A-Z])', 1) group by l.symbol""")
def j18(spark, sf):
    found = X.find_symbols(M.messages(spark, sf), M.listed_companies(spark, sf))
    return found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("j19_symbol_mentions", B.with_(B.BARS, B.MESSAGES) + """ select regexp_extract(text, '(SYM[A-Z])', 1) as symbol, message_id, 1 as kind from messages
  where regexp_extract(text, '(SYM[A-Z])', 1) in (select symbol from bars)
  union all select 'S&P-X', message_id, 2 from messages where text like 'buy%'""")
def j19(spark, sf):
    # Quoted symbols match, longer words and glued ones do not, symbols with & and - do.
    m = M.messages(spark, sf)
    noisy = m.withColumn("text", F.concat(
        F.lit("XSYMA SYMB9 ("), F.col("text"), F.lit(") S&P-XY"),
        F.when(F.col("text").startswith("buy"), " on S&P-X, now").otherwise("")))
    symbols = M.bars(spark, sf).select("symbol").distinct().unionByName(spark.createDataFrame([("S&P-X",)], "symbol string"))
    return X.symbol_mentions(noisy, symbols).select(
        "symbol", "message_id", F.when(F.col("symbol") == "S&P-X", 2).otherwise(1).alias("kind"))


@query("j20_latest_and_peak", B.with_(B.BARS) + f""" select symbol, max(date) as latest_date, arg_max(close, date) as latest_price, max(close) as peak_price,
  arg_max(date, (close, -(date - date '1970-01-01'))) as peak_date from bars where date >= date '{AS_OF}' group by symbol""")
def j20(spark, sf):
    return post_signal_stats(M.bars(spark, sf), AS_OF)


_GRID = [(tp, sl, 15) for tp in (10, 20) for sl in (5, 8)]


@query("j21_trades_by_grid", B.with_(B.SCORED, grid_sql(_GRID)) + " select tp, sl, h::int as h, count(*) as n, round(sum(ret), 4) as total from resolved_trades group by tp, sl, h")
def j21(spark, sf):
    from .evaluation_q import _paths
    g = E.trade_grid(_paths(spark, sf), _GRID)
    return g.select("tp", "sl", "h", "n", F.round(F.col("avg_ret") * F.col("n"), 4).alias("total"))


# ---- calendar ------------------------------------------------------------------------

_HOL = "('15082025', '27082025', '02102025', '21102025', '22102025', '05112025', '25122025')"


@query("d01_trading_day", B.with_(B.BARS) + f" select distinct date, isodow(date) <= 5 and strftime(date, '%d%m%Y') not in {_HOL} as open_day from bars")
def d01(spark, sf):
    return M.bars(spark, sf).select("date").distinct().withColumn("open_day", C.is_trading_day(F.col("date")))


@query("d02_previous_trading_day", B.with_(B.BARS) + """ select distinct date, case isodow(date) when 1 then date - 3 when 7 then date - 2 else date - 1 end as previous_day from bars""")
def d02(spark, sf):
    return M.bars(spark, sf).select("date").distinct().withColumn("previous_day", C.previous_trading_day(F.col("date")))


@query("d03_trading_range", B.with_(B.BARS) + f""", m as (select date_trunc('month', date)::date as a, max(date) as b from bars group by 1)
  select strftime(g, '%d%m%Y') as day from (select unnest(generate_series(a, b, interval 1 day)) as g from m) where isodow(g) <= 5 and strftime(g, '%d%m%Y') not in {_HOL}""")
def d03(spark, sf):
    months = M.bars(spark, sf).groupBy(F.trunc("date", "month").alias("start")).agg(F.max("date").alias("end"))
    days = C.date_spine(months).where(C.is_trading_day(F.col("date")))
    return days.select(F.date_format("date", "ddMMyyyy").alias("day"))


@query("d04_parse_dates", B.with_(B.BARS) + " select date, count(*) as n from bars group by date union all select null, 1")
def d04(spark, sf):
    b = M.bars(spark, sf).select("symbol", "date")
    text = F.when(F.day("date") > 10, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", " ddMMyyyy"))
    bad = spark.createDataFrame([("1999/01/01",)], "t string")
    return b.select(text.alias("t")).unionByName(bad).select(FI.parse_date(F.col("t")).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


_RUNS = """, days as (select distinct {by} date from {src}), j as (select *, case when date - lag(date) over ({part} order by date) > 7 then 1 else 0 end as j from days),
  r as (select *, sum(j) over ({part} order by date)::int as run from j)"""


@query("d05_missing_ranges", B.with_(B.BARS) + """, lim as (select min(date) as a, max(date) as b from bars where volume >= 600000),
  gap as (select g::date as date from (select unnest(generate_series(a, b, interval 1 day)) as g from lim) where isodow(g) <= 5
    and g::date not in (select date from bars where volume >= 600000))""" + _RUNS.format(by="", src="gap", part="") + """
  select run, min(date) as first_date, max(date) as last_date, count(*) as days from r group by run""")
def d05(spark, sf):
    return C.date_runs(C.missing_weekdays(M.bars(spark, sf).where(F.col("volume") >= 600_000)))


@query("w29_date_runs", B.with_(B.BARS) + _RUNS.format(by="symbol,", src="bars", part="partition by symbol") + """
  select symbol, run, min(date) as first_date, max(date) as last_date, count(*) as days from r group by symbol, run""")
def w29(spark, sf):
    return C.date_runs(M.bars(spark, sf), by=("symbol",))


# ---- leadership history -----------------------------------------------------------------

LEADERS = """
lcal as (select date, row_number() over (order by date) as session from (select distinct date from ind)),
l0 as (select i.*, c.session, coalesce(rs_vs_market >= 15, false)::int as lead_day from ind i join lcal c on c.date = i.date),
l1 as (select *, sum(lead_day) over (partition by symbol order by session range between 19 preceding and current row)::int as leader_days from l0),
leaders as (select a.symbol, a.date, a.leader_days, a.leader_days >= 12 as persistent, a.lead_day = 1 and a.leader_days - 1 <= 2 as new_leader,
   coalesce(a.rel_volume >= 3, false) and coalesce(a.rs_vs_market > 0 and a.rs_vs_market <= 25 and a.rs_vs_market > b.rs_vs_market, false) as emerging
   from l1 a left join l1 b on b.symbol = a.symbol and b.session = a.session - 5)"""


@query("w22_leader_history", B.with_(B.BARS, B.INDICATORS, LEADERS) + " select symbol, date, leader_days, persistent, new_leader from leaders")
def w22(spark, sf):
    return TR.leadership_history(indicators(spark, sf), bars=M.bars(spark, sf), t=T).drop("emerging")


STRIP = f"""
last20 as (select date, row_number() over (order by date) as slot from (select distinct date from ind where date <= date '{SHEET_DAY}' order by date desc limit 20)),
present as (select distinct symbol from ind join last20 using (date)),
cells as (select p.symbol, l.slot, case when rs_vs_market >= 15 then 2 when rs_vs_market is not null then 1 else 0 end as v from present p, last20 l
   left join ind i on i.symbol = p.symbol and i.date = l.date),
strips as (select symbol, string_agg(v::varchar, '' order by slot) as strip, count(*) filter (where v = 2)::int as leader_days,
   (20 - coalesce(max(slot) filter (where v <> 2), 0))::int as streak from cells group by symbol)"""


@query("w22b_leadership_strip", B.with_(B.BARS, B.INDICATORS, STRIP) + """, sp as (select i.symbol, string_agg(round(close, 2)::varchar, ' ' order by i.date) as spark from ind i join last20 l on l.date = i.date group by i.symbol)
  select s.symbol, strip, leader_days, streak, leader_days >= 12 as persistent from strips s""")
def w22b(spark, sf):
    return TR.leadership(indicators(spark, sf), SHEET_DAY, t=T).select(
        "symbol", F.array_join(F.col("strip").cast("array<string>"), "").alias("strip"), "leader_days", "streak", "persistent")


@query("w25_emerging", B.with_(B.BARS, B.INDICATORS, LEADERS) + " select symbol, date, emerging from leaders")
def w25(spark, sf):
    return TR.leadership_history(indicators(spark, sf), bars=M.bars(spark, sf), t=T).select("symbol", "date", "emerging")


@query("w26_sparkline", B.with_(B.BARS, B.INDICATORS, STRIP) + """ select i.symbol, count(*)::int as points, round(sum(round(close, 2)), 2) as total, arg_max(round(close, 2), i.date) as last_point
  from ind i join last20 l on l.date = i.date group by i.symbol""")
def w26(spark, sf):
    lead = TR.leadership(indicators(spark, sf), SHEET_DAY, t=T)
    return lead.select("symbol", F.size("spark").alias("points"), F.round(
        F.aggregate("spark", F.lit(0.0), lambda a, x: a + x), 2).alias("total"), F.element_at("spark", -1).alias("last_point"))


@query("t02_session_calendar", B.with_(B.BARS) + " select date, row_number() over (order by date)::int as session, lag(date) over (order by date) as prev_date from (select distinct date from bars)")
def t02(spark, sf):
    return session_calendar(M.bars(spark, sf))


@query("j05b_benchmark_returns", IND_SQL + " select date, round(ret_20d, 6) as benchmark_ret_20d from ind where symbol = 'SYMA'")
def j05b(spark, sf):
    return rounded(benchmark_returns(indicators(spark, sf), t=T), "benchmark_ret_20d")
