"""Shared SQL building blocks: each block is a list of CTEs over the given tables.

These restate the derived tables independently in ANSI-style SQL so that every
registered query can be checked by another engine.
"""

from __future__ import annotations

from ..settings import (BASE_KEYWORDS, BREAKOUT_KEYWORDS, HORIZONS, MOMENTUM_KEYWORDS, SCREENER_WEIGHTS,
                        TRUSTED_AFTER_BARS)
from ..sources.market_tables import SCREENER_OF_CODE

SYM = "'SYM' || chr(64 + cast(regexp_extract(p_brand, '([0-9]+)', 1) as int))"

BARS = f"""
trades as (
  select {SYM} as symbol, cast(l_shipdate as date) as date, l.*
  from lineitem l join part p on l.l_partkey = p.p_partkey),
bar_day as (
  select symbol, date, cast(sum(cast(round(l_discount * 100) as bigint) - 5) as bigint) as tick, count(*) as n,
    max(cast(round(l_tax * 100) as bigint)) as tmax, min(cast(round(l_tax * 100) as bigint)) as tmin,
    sum(l_quantity) as q, sum(case when l_linestatus = 'F' then l_quantity else 0.0 end) as qf
  from trades group by symbol, date),
bar_lvl as (select *, cast(sum(tick) over (partition by symbol order by date) as bigint) as lvl from bar_day),
bar_oc as (
  select *, cast(round(exp(lvl * 0.005::double) * 10000) as bigint) as close_c,
    cast(round(exp((lvl - tick) * 0.005::double) * 100 * (100 + 2.5::double * (n % 5 - 2))) as bigint) as open_c
  from bar_lvl),
bars as (
  select symbol, date, open_c / 100 as open,
    floor(greatest(open_c, close_c) * (1000 + tmax * 2) / 1000) / 100 as high,
    floor(least(open_c, close_c) * (1000 - tmin * 2) / 1000) / 100 as low,
    close_c / 100 as close, cast(q * q * 50 as bigint) as volume, qf * 100 / q as deliv_per, qf as deliv_qty
  from bar_oc)"""

SECTORS = f"""
sectors as (
  select distinct {SYM} as symbol,
    case when cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 6 = 5 then 'Equity'
         else 'SEC' || cast(cast(regexp_extract(p_brand, '([0-9]+)', 1) as int) % 6 as varchar) end as sector
  from part)"""

_codes = ", ".join(f"('{c}', '{n}')" for c, n in SCREENER_OF_CODE.items())
HITS = f"""
codes(code, screener) as (values {_codes}),
hits as (
  select distinct t.symbol, t.date, c.screener
  from trades t join orders o on t.l_orderkey = o.o_orderkey
  join codes c on c.code = o.o_orderpriority || '|' || o.o_orderstatus)"""

DEALS = """
deals as (
  select symbol, date, case when l_linestatus = 'F' then 'bulk' else 'block' end as kind,
    case when l_returnflag = 'R' then 'BUY' else 'SELL' end as side, l_quantity as quantity, s_name as client
  from trades join supplier on l_suppkey = s_suppkey where l_returnflag in ('R', 'A'))"""

MESSAGES = """
messages as (
  select event_id as message_id, date '1996-01-01' + cast(event_id % 1500 as int) as date,
    case when user_id % 5 = 0 then cast(user_id as varchar) else 'user' || cast(user_id as varchar) end as sender,
    case event_type when 'purchase' then 'buy' when 'error' then 'exit' else 'watch' end || ' SYM'
      || chr(cast(64 + event_id % 25 + 1 as int)) || ' above ' || cast(cast(round(value) as bigint) as varchar)
      || ' target ' || cast(cast(round(value) as bigint) * 2 as varchar)
      || ' sl ' || cast(cast(round(value) as bigint) - 3 as varchar)
      || case when event_type = 'signup' then ' positional' else '' end as text,
    'g' || cast(user_id % 3 as varchar) as group_id
  from events)"""

LISTED = f"""
listed as (
  select {SYM} as symbol, upper(replace(min(p_name), ' ', ''))
    || chr(64 + cast(regexp_extract(p_brand, '([0-9]+)', 1) as int)) || ' Industries Limited' as company_name
  from part group by p_brand)"""


def _roll(fn: str, col: str, n: int, need: int) -> str:
    frame = f"over (partition by symbol order by date rows between {n - 1} preceding and current row)"
    return f"case when count({col}) {frame} >= {need} then {fn}({col}) {frame} end"


def segments(source: str = "bars", gap: int = 5) -> str:
    return f"""
seg0 as (select *, lag(date) over (partition by symbol order by date) as pd,
           lag(close) over (partition by symbol order by date) as pc from {source}),
seg1 as (select *, cast(sum(case when date - pd > {gap} then 1 else 0 end)
           over (partition by symbol order by date) as int) as seg from seg0),
seg2 as (select *, cast(row_number() over (partition by symbol, seg order by date) as int) as bars_since_gap from seg1)"""


_masked = ",\n    ".join(
    f"case when bars_since_gap >= {need} then {c} end as {c}" for c, need in TRUSTED_AFTER_BARS.items())

TRUE_RANGE = """
tr0 as (select *, case when bars_since_gap = 1 then high - low
           else greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from seg2)"""

INDICATORS = segments() + "," + TRUE_RANGE + f""",
ind0 as (
  select *, {_roll('avg', 'tr', 14, 7)} as atr14,
    {_roll('avg', 'close', 20, 20)} as sma20, {_roll('avg', 'close', 50, 50)} as sma50,
    {_roll('avg', 'close', 150, 150)} as sma150, {_roll('avg', 'close', 200, 200)} as sma200,
    (close / ({_roll('max', 'close', 252, 20)}) - 1) * 100 as pct_from_52w_high,
    (close / ({_roll('min', 'close', 252, 20)}) - 1) * 100 as pct_from_52w_low,
    ({_roll('avg', 'tr', 5, 5)}) / nullif({_roll('avg', 'tr', 20, 20)}, 0) as range_contraction_ratio,
    volume / nullif({_roll('avg', 'volume', 20, 20)}, 0) as rel_volume,
    close / lag(close, 20) over (partition by symbol order by date) - 1 as ret_20d
  from tr0),
ind1 as (
  select *, atr14 / close * 100 as atr_pct,
    coalesce(close > sma50, false) and coalesce(sma50 > sma150, false) and coalesce(sma150 > sma200, false)
    and coalesce(sma200 > lag(sma200, 20) over (partition by symbol order by date), false)
    and coalesce(pct_from_52w_high >= -25, false) and coalesce(pct_from_52w_low >= 30, false) as trend_template_pass
  from ind0),
ind2 as (
  select symbol, date, open, high, low, close, volume, deliv_per, pc, seg, bars_since_gap,
    {_masked}
  from ind1),
ind as (
  select i.*, b.ret_20d as benchmark_ret_20d, (i.ret_20d - b.ret_20d) * 100 as rs_vs_market
  from ind2 i left join (select date, ret_20d from ind2 where symbol = 'SYMA') b on i.date = b.date)"""

NORM = ("trim(upper(regexp_replace(trim(regexp_replace(trim({0}), '[_\\-\\s]*\\d{{6,8}}$', '')), "
        "'[\\s\\-]+', '_', 'g')), '_')")
CATEGORY = ("case when regexp_matches({0}, '" + "|".join(BASE_KEYWORDS) + "') then 'base' "
            "when regexp_matches({0}, '" + "|".join(BREAKOUT_KEYWORDS) + "') then 'breakout' "
            "when regexp_matches({0}, '" + "|".join(MOMENTUM_KEYWORDS) + "') then 'momentum' else 'base' end")
_weights = ", ".join(f"('{n}', {w})" for n, w in SCREENER_WEIGHTS.items())

# Sheet history: one row per symbol and date with the facts the scorer reads.
SHEET = BARS + "," + SECTORS + "," + HITS + "," + DEALS + f""",
weights(norm, weight) as (values {_weights}),
named as (select *, {NORM.format('screener')} as norm from hits),
tagged as (select n.*, {CATEGORY.format('norm')} as cat from named n),
points as (
  select symbol, date, least(cast(sum(coalesce(weight, 3)) as int), 30) as pattern_points from
    (select distinct symbol, date, norm from tagged) d left join weights w on w.norm = d.norm group by symbol, date),
lists as (
  select symbol, date, list_sort(list(screener)) as screeners,
    list_sort(coalesce(list(screener) filter (where cat = 'breakout'), [])) as breakout,
    list_sort(coalesce(list(screener) filter (where cat = 'momentum'), [])) as momentum,
    list_sort(coalesce(list(screener) filter (where cat = 'base'), [])) as base
  from tagged group by symbol, date),
cal as (select date, lag(date) over (order by date) as prev_date from (select distinct date from hits) d),
listed_prev as (
  select l.*, p.screeners as prev_screeners
  from lists l join cal c on l.date = c.date
  left join lists p on p.symbol = l.symbol and p.date = c.prev_date),
fresh as (
  select *, case when prev_screeners is null then screeners
      else list_sort(list_filter(screeners, lambda s: not list_contains(prev_screeners, s))) end as new_screeners,
    len(screeners) as today_count, len(screeners) - coalesce(len(prev_screeners), 0) as count_diff
  from listed_prev),
deal_sum as (
  select symbol, date,
    sum(case when kind = 'bulk' and side = 'BUY' then quantity else 0.0 end) as bulk_buy,
    sum(case when kind = 'bulk' and side = 'SELL' then quantity else 0.0 end) as bulk_sell,
    count(*) filter (where kind = 'bulk') as n_bulk,
    sum(case when kind = 'block' and side = 'BUY' then quantity else 0.0 end) as block_buy,
    sum(case when kind = 'block' and side = 'SELL' then quantity else 0.0 end) as block_sell,
    count(*) filter (where kind = 'block') as n_block
  from deals group by symbol, date),
sheet as (
  select f.symbol, f.date, b.close as price,
    (b.close / lag(b.close) over (partition by b.symbol order by b.date) - 1) * 100 as chg,
    b.volume, b.deliv_per, s.sector, f.screeners, f.new_screeners, f.breakout, f.momentum, f.base,
    f.prev_screeners, p.pattern_points, f.today_count, f.count_diff,
    case when n_bulk > 0 then bulk_buy when n_block > 0 then block_buy end as buy_qty,
    case when n_bulk > 0 then bulk_sell when n_block > 0 then block_sell end as sell_qty
  from fresh f join points p on p.symbol = f.symbol and p.date = f.date
  join bars b on b.symbol = f.symbol and b.date = f.date
  join sectors s on s.symbol = f.symbol
  left join deal_sum d on d.symbol = f.symbol and d.date = f.date)"""


def path_cte(source: str, price: str, n: int, keys: str, cap: float | None, scale: float, name: str) -> str:
    """Long-format forward path: (symbol, date, k, r) for the usable prefix only."""
    cap_sql = f" or abs(r) > {cap}" if cap is not None else ""
    return f"""
{name}_n as (select {keys}, date, {price} as px, row_number() over (partition by {keys} order by date) as rn from {source}),
{name}_j as (
  select a.symbol, a.date, b.rn - a.rn as k,
    case when a.px > 0 and b.px > 0 then (b.px / a.px - 1.0) * {scale}::double end as r
  from {name}_n a join {name}_n b on {' and '.join(f'a.{k} = b.{k}' for k in keys.replace(' ', '').split(','))}
    and b.rn > a.rn and b.rn <= a.rn + {n}),
{name}_bad as (select symbol, date, min(k) as bad from {name}_j where r is null{cap_sql} group by symbol, date),
{name} as (select j.* from {name}_j j left join {name}_bad x on x.symbol = j.symbol and x.date = j.date
  where x.bad is null or j.k < x.bad)"""


_hmax = ", ".join(f"max(r) filter (where k <= {h}) as future_max_{h}d" for h in HORIZONS)
_htouch = ", ".join(
    f"case when future_max_{h}d >= 20 then 1 when future_max_{h}d is not null then 0 end as upside_touched_{h}d"
    for h in HORIZONS)


def labels(source: str = "sheet", tp: float = 25, sl: float = -5, horizon: int = 30) -> str:
    return f"""
lab_seg0 as (select symbol, date, price, lag(date) over (partition by symbol order by date) as pd from {source}),
lab_seg as (select symbol, date, price, cast(sum(case when date - pd > 5 then 1 else 0 end)
   over (partition by symbol order by date) as int) as seg from lab_seg0),""" + path_cte(
        "lab_seg", "price", 30, "symbol, seg", 100, 100, "lp") + f""",
lab0 as (
  select symbol, date, {_hmax}, max(k) filter (where k <= {horizon}) as nk,
    arg_min(r, k) filter (where k <= {horizon} and (r <= {sl} or r >= {tp})) as hit
  from lp group by symbol, date),
lab as (
  select *, {_htouch},
    case when hit is not null then case when hit <= {sl} then 0 else 1 end when nk >= {horizon} then 0 end as tradable_win
  from lab0)"""


LABELS = labels()

# Scored and labeled history (volume percentile over the whole day, as in the backtest).
SCORED = SHEET + "," + INDICATORS + "," + LABELS + """,
ranked_volume as (
  select *, (rank() over (partition by date order by volume)
     + (count(*) over (partition by date, volume) - 1) / 2.0) / count(volume) over (partition by date) as volume_pct
  from sheet),
parts as (
  select r.*, i.rs_vs_market, i.atr_pct, i.rel_volume,
    greatest(least(today_count * 2, 10) + case when count_diff > 0 then 5 when count_diff < 0 then -3 else 0 end
      + case when len(list_filter(new_screeners, lambda s: list_contains(breakout, s) or list_contains(momentum, s))) > 0
             then 5 else 0 end, 0) as confluence_points,
    least(case when chg >= 1 and chg <= 8 then 7 when chg > 8 and chg <= 15 then 4 when chg > 15 then 1 else 0 end
      + cast(round_even(volume_pct * 8, 0) as int), 10) as momentum_points,
    case when buy_qty > sell_qty then 10 when sell_qty > buy_qty then -8 else 0 end as institutional_points,
    case when i.rs_vs_market is null then 0 else cast(floor(least(greatest(i.rs_vs_market, 0), 35)) as int) end as rs_points
  from ranked_volume r left join ind i on i.symbol = r.symbol and i.date = r.date),
scored as (
  select p.*,
    cast(least(greatest(pattern_points + confluence_points + momentum_points + institutional_points + rs_points, 0), 100) as int) as score,
    cast(least(greatest(pattern_points + confluence_points + momentum_points + institutional_points, 0), 100) as int) as score_no_rs,
    len(breakout) > 0 as has_breakout_pattern,
    case when len(breakout) > 0 then 'Breakout / Momentum'
         when len(momentum) > 0 and len(base) = 0 then 'Momentum continuation'
         when len(base) > 0 then 'Base / Support (early-stage, needs confirmation)'
         else 'Mixed / weak signal' end as setup_type,
    case when f_prem and (f_sup or f_fib or f_con) and not f_brk then 'Rebound Setup'
         when f_prem and (f_brk or f_mom) and count_diff >= 3 then 'Breakout Trigger'
         when f_brk or f_mom then 'Momentum Continuation' else 'Neutral' end as rule_phase
  from (select *, regexp_matches(txt, '(?i)Premium_7\\.1') as f_prem, regexp_matches(txt, '(?i)BREAKOUT|RESISTANCE') as f_brk,
      regexp_matches(txt, '(?i)MOMENTUM') as f_mom, regexp_matches(txt, '(?i)SUPPORT') as f_sup,
      regexp_matches(txt, '(?i)FIB') as f_fib, regexp_matches(txt, '(?i)CONTRACTION') as f_con
    from (select *, array_to_string(screeners, ', ') as txt from parts)) p),
labeled as (
  select s.*, """ + ", ".join(f"l.future_max_{h}d, l.upside_touched_{h}d" for h in HORIZONS) + """, l.tradable_win
  from scored s left join lab l on l.symbol = s.symbol and l.date = s.date),
gated as (
  select * from labeled where coalesce(price, 0) >= 20 and coalesce(volume, 0) >= 50000
    and not (regexp_matches(symbol, '(?i)ETF|BEES|IETF|LIQUID') or coalesce(sector = 'Equity', false)))"""


def with_(*blocks: str) -> str:
    return "with " + ",".join(b.strip() for b in blocks)
