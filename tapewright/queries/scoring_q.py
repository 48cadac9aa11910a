"""Score components, phases and the candidate list (X, P and J8 rows)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import screeners as SC
from ..functions import views as V
from ..operators import sheets as SH
from ..operators.ranking import percentile_rank
from ..operators.timeseries import latest_as_of
from ..plans import scorecard as P
from ..sources import market_tables as M
from . import blocks as B
from .frames import T, indicators, sheet
from .registry import query
from .windows_q import AS_OF, pick, rounded

SHEET_SQL, SCORED_SQL = B.with_(B.SHEET), B.with_(B.SCORED)


@query("x01_normalize_screener", SHEET_SQL + " select screener, norm, count(*) as n from named group by all")
def x01(spark, sf):
    return M.screener_hits(spark, sf).groupBy("screener").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "norm", SC.normalize_screener(F.col("screener")))


@query("x02_categorize_screener", SHEET_SQL + " select cat, count(*) as n, count(distinct norm) as names from tagged group by cat")
def x02(spark, sf):
    h = M.screener_hits(spark, sf).withColumn("norm", SC.normalize_screener(F.col("screener")))
    return h.withColumn("cat", SC.categorize_screener(F.col("norm"))).groupBy("cat").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("norm").alias("names"))


@query("x03_split_screeners", SHEET_SQL + " select symbol, date, len(screeners)::int as n, screeners[1] as first_name from lists")
def x03(spark, sf):
    m = SH.merge_hits(M.screener_hits(spark, sf), ("symbol", "date"))
    text = F.concat(F.lit(" ,"), F.array_join("screeners", " ,  "), F.lit(", "))
    return m.withColumn("s", SC.split_list(text)).select(
        "symbol", "date", F.size("s").alias("n"), F.element_at("s", 1).alias("first_name"))


@query("x04_pattern_score", SHEET_SQL + """ select l.symbol, l.date, pattern_points, array_to_string(breakout, ',') as breakout,
  array_to_string(momentum, ',') as momentum, array_to_string(base, ',') as base
  from lists l join points p on p.symbol = l.symbol and p.date = l.date""")
def x04(spark, sf):
    m = SH.merge_hits(M.screener_hits(spark, sf), ("symbol", "date"))
    cats = {c: F.array_join(SC.in_category(F.col("screeners"), c), ",") for c in ("breakout", "momentum", "base")}
    return m.withColumns(cats).select(
        "symbol", "date", SC.pattern_score(F.col("screeners")).alias("pattern_points"), *cats)


@query("x05_confluence_score", SCORED_SQL + " select symbol, date, confluence_points::int as confluence_points from parts")
def x05(spark, sf):
    m = SH.compare_history(SH.merge_hits(M.screener_hits(spark, sf).withColumn("chg", F.lit(0.0)), ("symbol", "date")))
    return m.select("symbol", "date", S.confluence_score(
        F.col("today_count"), F.col("count_diff"), S.fresh_triggers(F.col("new_screeners"))).alias("confluence_points"))


@query("x06_momentum_volume_score", SCORED_SQL + " select symbol, date, momentum_points from parts")
def x06(spark, sf):
    df = percentile_rank(sheet(spark, sf).select("symbol", "date", "chg", "volume"), ["date"], "volume", "vp")
    return df.select("symbol", "date", S.momentum_volume_score(F.col("chg"), F.col("vp"), T).alias("momentum_points"))


@query("x07_institutional_score", SCORED_SQL + " select symbol, date, institutional_points from parts")
def x07(spark, sf):
    return sheet(spark, sf).select("symbol", "date", S.institutional_score(F.col("buy_qty"), F.col("sell_qty")).alias("institutional_points"))


@query("x08_relative_strength_score", B.with_(B.BARS, B.INDICATORS) + """ select symbol, date,
  case when rs_vs_market is null then 0 else floor(least(greatest(rs_vs_market, 0), 35))::int end as rs_points from ind""")
def x08(spark, sf):
    return indicators(spark, sf).select("symbol", "date", S.relative_strength_score(F.col("rs_vs_market")).alias("rs_points"))


RISK = """
levels0 as (select symbol, date, close, atr_pct, coalesce(atr_pct > 0, false) as sized,
  case when coalesce(atr_pct > 0, false) then least(greatest(1.5 * atr_pct, 5), 10) else 6 end as stop_pct from ind),
levels1 as (select *, case when sized then least(greatest(5 * stop_pct, 15), 40) else 30 end as target_pct from levels0),
levels as (select *, close * (1 - stop_pct / 100) as stop_price, close * (1 + target_pct / 100) as target_price,
  target_pct / stop_pct as rr, case when sized then 'ATR' else 'flat' end as basis from levels1)"""


@query("x09_risk_levels", B.with_(B.BARS, B.INDICATORS, RISK) + f"""
  select symbol, date, {pick('stop_pct', 'target_pct', 'stop_price', 'target_price', 'rr')}, basis from levels""")
def x09(spark, sf):
    df = indicators(spark, sf).select("symbol", "date", S.risk_levels(F.col("close"), F.col("atr_pct"), T).alias("l"))
    return rounded(df.select("symbol", "date", "l.*"), "stop_pct", "target_pct", "stop_price", "target_price", "rr")


@query("x10_setup_type", SCORED_SQL + " select symbol, date, setup_type from scored")
def x10(spark, sf):
    m = SH.merge_hits(M.screener_hits(spark, sf), ("symbol", "date"))
    cats = [SC.in_category(F.col("screeners"), c) for c in ("breakout", "momentum", "base")]
    return m.select("symbol", "date", S.setup_type(*cats).alias("setup_type"))


@query("x11_total_score", SCORED_SQL + " select symbol, date, score, score_no_rs from scored")
def x11(spark, sf):
    return P.score_history(sheet(spark, sf), indicators(spark, sf), t=T).select("symbol", "date", "score", "score_no_rs")


NOTES = """
live0 as (select * from sheet where coalesce(price, 0) >= 20 and coalesce(volume, 0) >= 50000 and sector is not null
    and not (regexp_matches(symbol, '(?i)ETF|BEES|IETF|LIQUID') or sector = 'Equity')),
live1 as (select *, (rank() over (partition by date order by volume)
     + (count(*) over (partition by date, volume) - 1) / 2.0) / count(volume) over (partition by date) as vp from live0),
live2 as (
  select l.*, i.rs_vs_market, i.atr_pct, v.stop_pct, v.target_pct, v.stop_price, v.target_price, v.rr, v.basis,
    greatest(least(today_count * 2, 10) + case when count_diff > 0 then 5 when count_diff < 0 then -3 else 0 end
      + case when len(list_filter(new_screeners, lambda s: list_contains(breakout, s) or list_contains(momentum, s))) > 0
             then 5 else 0 end, 0) as cp,
    least(case when chg >= 1 and chg <= 8 then 7 when chg > 8 and chg <= 15 then 4 when chg > 15 then 1 else 0 end
      + cast(round_even(vp * 8, 0) as int), 10) as mp,
    case when buy_qty > sell_qty then 10 when sell_qty > buy_qty then -8 else 0 end as ip,
    case when i.rs_vs_market is null then 0 else cast(floor(least(greatest(i.rs_vs_market, 0), 35)) as int) end as rp,
    list_filter(new_screeners, lambda s: list_contains(breakout, s) or list_contains(momentum, s)) as trig
  from live1 l left join ind i on i.symbol = l.symbol and i.date = l.date
  left join levels v on v.symbol = l.symbol and v.date = l.date),
live3 as (select *, cast(least(greatest(pattern_points + cp + mp + ip + rp, 0), 100) as int) as score from live2),
live as (
  select *, row_number() over (partition by date order by score desc, symbol)::int as rank,
    concat_ws('; ', 'patterns: ' || case when len(breakout) + len(momentum) = 0 then 'none' else array_to_string(list_concat(breakout, momentum), ', ') end,
      case when count_diff > 0 then 'strengthening (+screeners vs yesterday)' when count_diff < 0 then 'weakening (-screeners vs yesterday)' end,
      case when len(trig) > 0 then 'fresh trigger today: ' || array_to_string(trig, ', ') end,
      case when chg >= 1 and chg <= 8 then printf('healthy move today (%+.1f%%)', chg) when chg > 8 and chg <= 15 then printf('strong move, some chase risk (%+.1f%%)', chg)
           when chg > 15 then printf('CAUTION extended (%+.1f%%)', chg) when chg < 0 then printf('down today (%+.1f%%)', chg) end,
      case when vp >= 0.9 then 'top-decile volume today' when vp >= 0.75 then 'elevated volume today' end,
      case when buy_qty > sell_qty then 'bulk/block BUY > SELL (' || format('{:,}', buy_qty::bigint) || ' vs ' || format('{:,}', sell_qty::bigint) || ')'
           when sell_qty > buy_qty then 'CAUTION bulk/block SELL > BUY (' || format('{:,}', sell_qty::bigint) || ' vs ' || format('{:,}', buy_qty::bigint) || ')' end,
      case when rs_vs_market >= 15 then printf('strong relative strength vs. market (+%.1fpp/20d)', rs_vs_market)
           when rs_vs_market >= 5 then printf('outperforming market (+%.1fpp/20d)', rs_vs_market)
           when rs_vs_market < 0 then printf('CAUTION lagging market (%+.1fpp/20d)', rs_vs_market) end) as reasoning
  from live3)"""
LIVE_SQL = B.with_(B.SHEET, B.INDICATORS, RISK, NOTES)


def candidates(spark, sf):
    return P.score_watchlist(sheet(spark, sf), indicators=indicators(spark, sf), by=("date",), t=T)


@query("x12_reasoning_text", LIVE_SQL + " select symbol, date, reasoning from live")
def x12(spark, sf):
    return candidates(spark, sf).select("symbol", "date", "reasoning")


@query("x13_since_signal", B.with_(B.BARS) + f""", s as (
  select symbol, arg_max(close, date) as latest, max(close) as peak from bars where date >= date '{AS_OF}' group by symbol)
  select b.symbol, b.date, round((latest / close - 1) * 100, 6) as chg_since_signal, round((peak / close - 1) * 100, 6) as chg_to_peak
  from bars b left join s on s.symbol = b.symbol""")
def x13(spark, sf):
    from ..operators.timeseries import post_signal_stats
    b = M.bars(spark, sf)
    df = b.join(post_signal_stats(b, AS_OF), "symbol", "left")
    return df.select(
        "symbol", "date", F.round(S.pct_move(F.col("close"), F.col("latest_price")), 6).alias("chg_since_signal"),
        F.round(S.pct_move(F.col("close"), F.col("peak_price")), 6).alias("chg_to_peak"))


@query("x14_candidate_ranking", LIVE_SQL + f""" select symbol, date, score, rank, basis as stop_basis,
  {pick('stop_price', 'target_price', 'rr')} from live""")
def x14(spark, sf):
    cols = ["stop_price", "target_price", "rr"]
    return rounded(candidates(spark, sf).select("symbol", "date", "score", "rank", "stop_basis", *cols), *cols)


@query("x15_rule_phase", SCORED_SQL + " select symbol, date, rule_phase from scored")
def x15(spark, sf):
    s = sheet(spark, sf)
    return s.select("symbol", "date", S.rule_phase(F.array_join("screeners", ", "), F.col("count_diff")).alias("rule_phase"))


STRENGTH = "['RT_SIDEWAY_BREAKOUT','RT_Range_Breakout_with_Volume','RT_Master_Resistance_Breakout_Screener','DARVAS','RT_52W_BREAKOUT','RT_SHORT_TO_MID_RANGE_BREAKOUT']"
PHASES = f"""
flags0 as (select *, list_has_any(new_screeners, {STRENGTH}) as firing, list_has_any(screeners, ['RT_MAJOR_SUPPORT','RT_Fib_0.7_to_0.88_Zone']) as sup,
  list_has_any(screeners, ['RT_Daily_Contraction','VCP']) as con, not coalesce(chg > 15, false) as calm, coalesce(rs_vs_market >= 5, false) as ahead,
  coalesce(rs_vs_market >= 15, false) as rs_strong, coalesce(vp >= 0.75, false) as vol_ok,
  len(list_filter(new_screeners, lambda s: list_contains(breakout, s))) > 0 as fresh,
  coalesce(chg >= 1 and chg <= 8, false) as healthy, coalesce(rs_vs_market < 0, false) as lagging,
  case when volume >= 100000 then 'EQ' else 'BE' end as series from live),
flags1 as (select *, case when firing and vol_ok and calm and ahead then 'SOS'
    when sup and not firing and calm and ahead and coalesce(chg >= -4 and chg <= 3, false) then 'LPS'
    when con and not firing then 'Base' else '' end as phase,
  (rs_strong::int + fresh::int + vol_ok::int + (healthy and calm)::int + (not lagging)::int + (series not in ('BE', 'BZ'))::int) as checks from flags0),
flags as (select *, case when checks >= 5 and rs_strong and fresh then 'A' when checks >= 3 then 'B' else 'C' end as tier from flags1)"""


def flagged(spark, sf):
    c = F.col
    df = candidates(spark, sf).withColumn("series", F.when(c("volume") >= 100000, "EQ").otherwise("BE"))
    f = S.triage_flags(c("new_screeners"), c("chg"), c("rs_vs_market"), c("volume_pct"), c("buy_qty"), c("sell_qty"), c("series"), T)
    checks = S.check_count(f)
    return df.withColumns({**f, "checks": checks, "tier": S.tier(f, checks), "phase": S.wyckoff_phase(
        c("new_screeners"), c("screeners"), f["vol_ok"], c("chg"), c("rs_vs_market"))})


@query("x16_wyckoff_phase", B.with_(B.SHEET, B.INDICATORS, RISK, NOTES, PHASES) + " select symbol, date, phase from flags")
def x16(spark, sf):
    return flagged(spark, sf).select("symbol", "date", "phase")


@query("x17_checks_and_tier", B.with_(B.SHEET, B.INDICATORS, RISK, NOTES, PHASES) + " select symbol, date, checks::int as checks, tier from flags")
def x17(spark, sf):
    return flagged(spark, sf).select("symbol", "date", "checks", "tier")


@query("x18_screener_changes", SHEET_SQL + """ select symbol, date, today_count::int as today_count, count_diff::int as count_diff,
  array_to_string(new_screeners, ',') as new_screeners, prev_screeners is not null as was_in_previous_sheet from fresh""")
def x18(spark, sf):
    m = SH.compare_history(SH.merge_hits(M.screener_hits(spark, sf).withColumn("chg", F.lit(0.0)), ("symbol", "date")))
    return m.select("symbol", "date", "today_count", "count_diff",
                    F.array_join("new_screeners", ",").alias("new_screeners"), "was_in_previous_sheet")


# ---- projections, filters, predicates ---------------------------------------------

@query("p01_live_gate", LIVE_SQL + " select symbol, date, price, volume from live0")
def p01(spark, sf):
    return P.live_gate(sheet(spark, sf), t=T).select("symbol", "date", "price", "volume")


@query("p02_backtest_gate", SHEET_SQL + """ select symbol, date, price, case when sector = 'SEC3' then null else sector end as sector from sheet
  where coalesce(price, 0) >= 20 and coalesce(volume, 0) >= 50000 and coalesce(sector, '') <> 'Equity'""")
def p02(spark, sf):
    s = sheet(spark, sf).withColumn("sector", F.nullif(F.col("sector"), F.lit("SEC3")))
    return P.backtest_gate(s, t=T).select("symbol", "date", "price", "sector")


@query("p03_staleness_filter", B.with_(B.BARS) + """ select s.as_of, b.symbol, max(b.date) as date from bars b,
  (values (date '1996-03-01'), (date '1999-06-30'), (date '2001-11-20')) s(as_of)
  where b.date <= s.as_of group by s.as_of, b.symbol having s.as_of - max(b.date) <= 7""")
def p03(spark, sf):
    b = M.bars(spark, sf).select("symbol", "date")
    out = None
    for d in ("1996-03-01", "1999-06-30", "2001-11-20"):
        part = latest_as_of(b.withColumn("day", F.col("date")).select("symbol", "date", "day"), d, t=T).select(
            F.lit(d).cast("date").alias("as_of"), "symbol", "date")
        out = part if out is None else out.unionByName(part)
    return out


@query("p04_shortlist", LIVE_SQL + """ select symbol, score, rank from live where date = (select max(date) from live where score >= 50)
  and score >= 50 order by rank limit 25""")
def p04(spark, sf):
    c = candidates(spark, sf).select("symbol", "date", "score", "rank")
    day = c.where(F.col("score") >= T.min_score).agg(F.max("date")).scalar()
    return P.shortlist(c.where(F.col("date") == day), t=T).select("symbol", "score", "rank")


@query("p09_resolved_only", SCORED_SQL + " select symbol, date, tradable_win::int as win, coalesce(upside_touched_20d, 0) as touch from labeled where tradable_win in (0, 1)")
def p09(spark, sf):
    from ..operators.labels import add_labels
    from ..plans.research import resolved
    return resolved(add_labels(sheet(spark, sf).select("symbol", "date", "price"), t=T)).select("symbol", "date", "win", "touch")


@query("p10_position_size", B.with_(B.BARS, B.INDICATORS, RISK) + """ select symbol, date,
  case when stop_price < close and floor(100000.0::double * 1.5 / 100 / (close - stop_price)) > 0
       then floor(100000.0::double * 1.5 / 100 / (close - stop_price))::bigint end as shares from levels""")
def p10(spark, sf):
    df = indicators(spark, sf).select("symbol", "date", "close", S.risk_levels(F.col("close"), F.col("atr_pct"), T).alias("l"))
    return df.select("symbol", "date", V.shares_for(F.col("close"), F.col("l.stop_price"), 100_000.0, 1.5).alias("shares"))


_CALLS = """
calls as (select m.message_id, m.date, b.close as price, cast(regexp_extract(text, 'target ([0-9]+)', 1) as double) as target,
   case when text like '%positional' then '2x' end as multiple, cast(month(m.date) * 20 as int) as call_days
  from messages m join bars b on b.symbol = regexp_extract(text, '(SYM[A-Z])', 1) and b.date = m.date)"""


def _calls(spark, sf):
    m = M.messages(spark, sf).withColumn("symbol", F.regexp_extract("text", "(SYM[A-Z])", 1))
    j = m.join(M.bars(spark, sf).select("symbol", "date", F.col("close").alias("price")), ["symbol", "date"])
    return j.select(
        "message_id", "date", "price", F.regexp_extract("text", "target ([0-9]+)", 1).try_cast("double").alias("target"),
        F.when(F.col("text").endswith("positional"), "2x").alias("multiple"), (F.month("date") * 20).alias("call_days"))


@query("p11_target_state", B.with_(B.BARS, B.MESSAGES, _CALLS) + """ select message_id,
  case when multiple is not null then case when call_days > 180 then 'old multiple' else 'multiple' end
       when target >= price * 0.4 and target <= price * 15 then case when call_days > 180 then 'historical' when target <= price then 'reached' else 'live' end end as state,
  case when multiple is null and target >= price * 0.4 and target <= price * 15 and call_days <= 180 and target > price
       then round((target / price - 1) * 100) end as upside_pct from calls""")
def p11(spark, sf):
    c = _calls(spark, sf)
    return c.select("message_id", V.target_state(F.col("price"), F.col("target"), F.col("multiple"), F.col("call_days")).alias("s")).select("message_id", "s.*")


@query("p12_mention_marker", B.with_(B.BARS, B.MESSAGES, _CALLS) + """, x as (
  select *, (call_days / 20)::int % 5 as mentions, case when multiple is not null then 'POSITIONAL' end as tag, (call_days / 10)::int as days,
    target > 100 as call from calls)
  select message_id, case when mentions = 0 and not call then 'none' when tag is not null and call_days <= 120 then 'recent'
      when call then 'mid' when days <= 3 then 'recent' when days <= 14 then 'mid' else 'stale' end as css,
    case when mentions = 0 and not call then '-' when tag is not null and call_days <= 120 then '*'
      when call then '^' when days <= 3 then '*' else '' end as mark from x""")
def p12(spark, sf):
    c = _calls(spark, sf).withColumns({
        "mentions": (F.col("call_days") / 20).cast("int") % 5, "tag": F.when(F.col("multiple").isNotNull(), "POSITIONAL"),
        "days": (F.col("call_days") / 10).cast("int"), "call": F.col("target") > 100})
    return c.select("message_id", V.mention_marker(
        F.col("mentions"), F.col("call"), F.col("tag"), F.col("days"), F.col("call_days")).alias("m")).select("message_id", "m.*")


@query("p13_score_breakdown", B.with_(B.SHEET, B.INDICATORS, RISK, NOTES, PHASES) + """, b as (
  select symbol, date, least(greatest(coalesce(rs_vs_market, 0), 0), 35) as a1, least(len(breakout) * 8 + case when fresh then 6 else 0 end, 30) as a2,
    case when fresh then 15 else 0 end as a3, case when vol_ok then 10 else 0 end as a4, case when buy_qty > sell_qty then 10 else 0 end as a5 from flags),
  tot as (select *, case when a1 + a2 + a3 + a4 + a5 = 0 then 1 else a1 + a2 + a3 + a4 + a5 end as t from b)
  select symbol, date, label, round(points::double, 6) as points, round(points / t * 100, 6) as pct from (
    select symbol, date, t, unnest(['RS', 'Patterns', 'Freshness', 'Volume', 'Big-player']) as label, unnest([a1::double, a2, a3, a4, a5]) as points from tot)""")
def p13(spark, sf):
    c = F.col
    df = flagged(spark, sf)
    parts = V.score_breakdown(c("rs_vs_market"), c("breakout"), c("fresh"), F.lit(False), c("vol_ok"), c("inst"))
    return rounded(df.select("symbol", "date", F.inline(parts)), "points", "pct")


@query("j08_snapshot_lookup", LIVE_SQL + """ select l.symbol, l.date, round(l.rs_vs_market, 6) as rs_vs_market, round(l.atr_pct, 6) as atr_pct from live l
  where date = (select max(date) from sheet)""")
def j08(spark, sf):
    s = sheet(spark, sf)
    day = M.screener_hits(spark, sf).agg(F.max("date")).first()[0]
    today = s.where(F.col("date") == F.lit(day)).drop("date")
    out = P.score_watchlist(today, M.bars(spark, sf), indicators(spark, sf), signal_date=day, t=replace(T, stale_after_days=0))
    return out.select("symbol", F.lit(day).alias("date"), F.round("rs_vs_market", 6).alias("rs_vs_market"), F.round("atr_pct", 6).alias("atr_pct"))
