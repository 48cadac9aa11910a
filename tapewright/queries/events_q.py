"""Text, mentions, ledger, triage, cohorts and streams (R, A26-A34, W28, P5-P8, ST rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import views as V
from ..operators import text as X
from ..plans import cohorts as CO
from ..plans import ledger as LG
from ..plans import research as RS
from ..plans import triage as TR
from ..session import cut_lineage, shared_folder
from ..settings import MENTION_STOPWORDS, RECOMMENDATION_STOPWORDS
from ..sources import market_tables as M
from ..sources import readers as RD
from ..streaming import ledger as SL
from ..streaming import messages as SM
from ..streaming import upsert as SU
from . import blocks as B
from .evaluation_q import RESOLVED
from .frames import T, indicators, stored_indicators
from .joins_q import LEADERS, STRIP, _last_two_sheets
from .registry import query
from .scoring_q import NOTES, PHASES, RISK, candidates
from .windows_q import AS_OF, SHEET_DAY, GAPS, PERSIST, pick, rounded

MSG = B.with_(B.MESSAGES)
_rstop = "(" + ", ".join(f"'{w}'" for w in RECOMMENDATION_STOPWORDS) + ")"
_mstop = "(" + ", ".join(f"'{w}'" for w in MENTION_STOPWORDS) + ")"

WORDS = """
words as (select word as token, min(symbol) as symbol from (select symbol, regexp_replace(split_part(upper(company_name), ' ', 1), '[^A-Z0-9]', '', 'g') as word from listed)
  where length(word) >= 5 group by word),
dictionary as (select symbol as token, symbol from listed union all select token, symbol from words where token not in (select symbol from listed)),
named as (select m.message_id, m.group_id, m.date, m.sender, 'add ' || split_part(company_name, ' ', 1) || '& &' || l.symbol || ' ' || m.text as text
  from messages m join listed l on l.symbol = 'SYM' || chr(cast(64 + (m.message_id * 7) % 25 + 1 as int)))"""


def _named(spark, sf):
    """Messages that also name a second company by word and by symbol."""
    m = M.messages(spark, sf)
    other = M.symbol_of_brand(((F.col("message_id") * 7) % 25 + 1).cast("int"))
    j = m.withColumn("symbol", other).join(M.listed_companies(spark, sf), "symbol")
    return j.withColumn("text", F.concat(
        F.lit("add "), F.split("company_name", " ")[0], F.lit("& &"), F.col("symbol"), F.lit(" "), F.col("text"))).drop("symbol", "company_name")


@query("r01_find_symbols", B.with_(B.MESSAGES, B.LISTED, WORDS) + f""", tok as (select message_id, unnest(regexp_extract_all(upper(text), '[A-Z&]{{3,}}')) as tk,
     generate_subscripts(regexp_extract_all(upper(text), '[A-Z&]{{3,}}'), 1) as at from named)
  select t.message_id, d.symbol, count(*) as seen from (select message_id, trim(tk, '&') as token from tok) t join dictionary d on d.token = t.token
  where length(t.token) >= 3 and t.token not in {_rstop} group by t.message_id, d.symbol""".replace("count(*) as seen", "1 as seen"))
def r01(spark, sf):
    found = X.find_symbols(_named(spark, sf), M.listed_companies(spark, sf))
    return found.select("message_id", "symbol", F.lit(1).alias("seen"))


@query("r02_company_words", B.with_(B.MESSAGES, B.LISTED, WORDS) + " select token, symbol from words")
def r02(spark, sf):
    return X.company_words(M.listed_companies(spark, sf))


@query("r02b_first_listing_wins", f"""with w as (select p_partkey, {B.SYM} as symbol,
    regexp_replace(split_part(upper(p_name), ' ', 1), '[^A-Z0-9]', '', 'g') as token from part)
  select token, arg_min(symbol, p_partkey) as symbol from w where length(token) >= 5 and token not in {_rstop} group by token""")
def r02b(spark, sf):
    """Every part as a listed company in a listing file; words are shared, the first line in the file has them."""
    parts = M.table(spark, sf, "part").orderBy("p_partkey").select(
        M.symbol_of_brand(F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")).alias("SYMBOL"), F.col("p_name").alias(" NAME OF COMPANY"))
    path = shared_folder(spark, "listing")
    parts.write.csv(path, header=True)
    return X.company_words(RD.read_listing(spark, path))


@query("t11_message_files", MSG + " select message_id, date, sender, text, group_id from messages")
def t11(spark, sf):
    """Messages written as the log's files and read back by column place."""
    path = shared_folder(spark, "message-files")
    M.messages(spark, sf).select("message_id", F.col("date").alias("date_ist"), "sender", "text", "group_id").write.csv(
        path, header=True, quote='"', escape='"')
    return RD.read_messages(spark, path)


@query("r03_direction", MSG + """ select message_id, case when regexp_matches(text, '(?i)\\b(buy|accumulate|add|long|enter|entry)\\b') then 'BUY'
  when regexp_matches(text, '(?i)\\b(sell|exit|book|short|profit\\s*book)\\b') then 'SELL' else '' end as direction from messages""")
def r03(spark, sf):
    return M.messages(spark, sf).select("message_id", X.direction(F.col("text")).alias("direction"))


_NUM = "([0-9]{2,6}(?:\\.[0-9]{1,2})?)"
_LEVELS = f"""try_cast(nullif(regexp_extract(text, '(?i)(?:above|entry|cmp|@|around|near)[\\s:=-]*{_NUM}', 1), '') as double) as entry,
  try_cast(nullif(regexp_extract(text, '(?i)(?:tgt|target|t\\d?)[\\s:=@-]*{_NUM}', 1), '') as double) as target,
  try_cast(nullif(regexp_extract(text, '(?i)(?:sl|stop\\s*loss|stoploss)[\\s:=@-]*{_NUM}', 1), '') as double) as sl"""


@query("r04_levels", MSG + f" select message_id, {_LEVELS} from messages")
def r04(spark, sf):
    t = F.col("text")
    return M.messages(spark, sf).select(
        "message_id", X.level(t, X.ENTRY_LEVEL).alias("entry"), X.level(t, X.TARGET_LEVEL).alias("target"), X.level(t, X.STOP_LEVEL).alias("sl"))


@query("r05_recommendations", B.with_(B.MESSAGES, B.LISTED, WORDS) + f""", tok as (select message_id, unnest(regexp_extract_all(upper(text), '[A-Z&]{{3,}}')) as tk from named),
  fs as (select distinct t.message_id, d.symbol from (select message_id, trim(tk, '&') as token from tok) t join dictionary d on d.token = t.token where length(t.token) >= 3 and t.token not in {_rstop})
  select n.message_id, n.date, n.sender as caller, f.symbol, 'BUY' as direction, {_LEVELS}, substr(text, 1, 200) as raw_text from named n join fs f on f.message_id = n.message_id""")
def r05(spark, sf):
    return X.recommendations(_named(spark, sf), M.listed_companies(spark, sf)).drop("group_id")


@query("r06_admin_and_tags", MSG + """ select message_id, regexp_full_match(sender, '-?[0-9]+') as admin,
  nullif(upper(regexp_extract(text, '(?i)(POSITIONAL|MULTIBAGGER|LONG\\s*TERM|FOCUS)', 1)), '') as tag from messages""")
def r06(spark, sf):
    return M.messages(spark, sf).select("message_id", X.is_admin(F.col("sender")).alias("admin"), X.conviction_tag(F.col("text")).alias("tag"))


TARGETS = """
tails as (select *, substr(text, instr(upper(text), 'TARGET'), 130) as tail from (select * replace (case when event_type = 'view' then replace(replace(text, 'target ', 'target 3x '), ' sl ', ' s/l') else text end as text)
   from messages m join events e on e.event_id = m.message_id)),
targets as (select message_id, list_max(list_filter(list_transform(regexp_extract_all(tail, '\\b([0-9]{2,6})\\b', 1), lambda s: s::double), lambda n: n >= 10)) as price,
  nullif(regexp_extract(tail, '(?i)([2-9])\\s*X\\b', 1), '') as times from tails)"""


@query("r07_admin_target", B.with_(B.MESSAGES, TARGETS) + " select message_id, price, case when price is null and times is not null then times || 'x' end as multiple from targets")
def r07(spark, sf):
    events = M.table(spark, sf, "events")
    m = M.messages(spark, sf).join(events.select(F.col("event_id").alias("message_id"), "event_type"), "message_id")
    altered = F.replace(F.replace("text", F.lit("target "), F.lit("target 3x ")), F.lit(" sl "), F.lit(" s/l"))
    t = F.when(F.col("event_type") == "view", altered).otherwise(F.col("text"))
    return m.select("message_id", X.admin_target(t).alias("t")).select("message_id", "t.*")


@query("r08_mention_tokens", B.with_(B.MESSAGES, B.LISTED, WORDS) + f""", tok as (select distinct message_id, date, sender, unnest(regexp_extract_all(upper(text || ' SYMB SYMC SYMD'), '[A-Z&]{{3,}}')) as token from named),
  hit as (select t.* from tok t join listed l on l.symbol = t.token where t.token not in {_mstop}),
  rk as (select *, row_number() over (partition by message_id order by token) as rn from hit)
  select message_id, date, regexp_full_match(sender, '-?[0-9]+') as admin, token as symbol from rk where rn <= 3""")
def r08(spark, sf):
    m = _named(spark, sf).withColumn("text", F.concat("text", F.lit(" SYMB SYMC SYMD")))
    return X.precedence_mentions(m, M.listed_companies(spark, sf)).drop("group_id")


def _mention_sql(day):
    return f"""
ms as (select *, regexp_extract(text, '(SYM[A-Z])', 1) as symbol, regexp_full_match(sender, '-?[0-9]+') as admin from messages where date <= date '{day}'),
stats as (select symbol, count(*) as mentions, count(*) filter (where admin) as admin_mentions, max(date) as last_date, (date '{day}' - max(date))::int as days_since
  from ms where date >= date '{day}' - 45 group by symbol),
called as (select symbol, date as call_date, list_max(list_filter(list_transform(regexp_extract_all(substr(text, instr(upper(text), 'TARGET'), 130), '\\b([0-9]{{2,6}})\\b', 1), lambda s: s::double), lambda n: n >= 10)) as target,
   case when text like '%positional%' then 'POSITIONAL' end as tag, (date '{day}' - date)::int as call_days
   from (select *, row_number() over (partition by symbol order by date desc, message_id desc) as rn from ms where admin) where rn = 1)"""


_MSTAT = _mention_sql(AS_OF)


def _symbols(spark, sf):
    return M.bars(spark, sf).select("symbol").distinct()


@query("a32_mention_stats", B.with_(B.MESSAGES, _MSTAT) + " select * from stats")
def a32(spark, sf):
    m = X.recent_messages(M.messages(spark, sf), AS_OF, 45)
    return X.mention_stats(X.symbol_mentions(m, _symbols(spark, sf)), AS_OF)


@query("a33_admin_calls", B.with_(B.MESSAGES, _MSTAT) + " select s.symbol, s.mentions, c.call_date, c.target, c.tag, c.call_days from stats s left join called c on c.symbol = s.symbol")
def a33(spark, sf):
    g = X.group_mentions(M.messages(spark, sf), _symbols(spark, sf), AS_OF, t=T)
    return g.select("symbol", "mentions", "call_date", "target", "tag", "call_days")


# ---- ledger ----------------------------------------------------------------------------

def exact_round(x, places):
    """Half-up rounding of the shortest decimal form, free of binary scaling."""
    return f"cast(round(cast(cast({x} as varchar) as decimal(38, 20)), {places}) as double)"


LEDGER = f"""
adm as (select distinct regexp_extract(text, '(SYM[A-Z])', 1) as symbol, date from messages where regexp_full_match(sender, '-?[0-9]+')),
positions as (
  select f.symbol, f.date as entry_date, f.price as entry_price, f.target_price as target, f.stop_price as stop, l.persistent, g.ep_raw and coalesce(g.close_pos >= 0.5, true) as ep,
    l.emerging, f.fresh, a.symbol is not null as rw_admin
  from flags f join leaders l on l.symbol = f.symbol and l.date = f.date join gaps g on g.symbol = f.symbol and g.date = f.date
  left join adm a on a.symbol = f.symbol and a.date = f.date where f.rank <= 3),
lb as (select symbol, date, high, low, close, row_number() over (partition by symbol order by date) as bn from bars),
pb as (select p.*, b.bn from positions p join lb b on b.symbol = p.symbol and b.date = p.entry_date),
wk as (select p.symbol, p.entry_date, b.bn - p.bn as k, b.date, b.high, b.low, b.close, p.entry_price, p.target, p.stop, b.low <= p.stop as s, b.high >= p.target as tg from pb p
   join lb b on b.symbol = p.symbol and b.bn > p.bn and b.bn <= p.bn + 20),
ex as (select symbol, entry_date, min(k) filter (where s or tg or k = 20) as xk, max(k) as nk from wk group by symbol, entry_date),
sm as (select w.symbol, w.entry_date, x.xk, max((w.high / entry_price - 1) * 100) as peak, count(*)::int as days_held, arg_max(close, k) as last_price,
   any_value(date) filter (where k = x.xk) as exit_date, any_value(s) filter (where k = x.xk) as s, any_value(tg) filter (where k = x.xk) as tg, any_value(close) filter (where k = x.xk) as xc
   from wk w join ex x on x.symbol = w.symbol and x.entry_date = w.entry_date where k <= coalesce(x.xk, 20) group by w.symbol, w.entry_date, x.xk),
ledger as (
  select p.*, case when m.xk is null then 'OPEN' when m.s then 'STOPPED' when m.tg then 'TARGET' else 'EXPIRED' end as status, m.exit_date,
    case when m.xk is null then null when m.s then p.stop when m.tg then p.target else m.xc end as level,
    greatest(0.0, coalesce(m.peak, 0)) as peak, coalesce(m.days_held, 0) as days_held, coalesce(m.last_price, p.entry_price) as last_price
  from positions p left join sm m on m.symbol = p.symbol and m.entry_date = p.entry_date),
led as (select *, {exact_round('level', 2)} as exit_price, {exact_round('(level / entry_price - 1) * 100', 1)} as realized_pct,
  {exact_round('peak', 1)} as peak_pct from ledger)"""
LEDGER_SQL = B.with_(B.SHEET, B.INDICATORS, RISK, NOTES, PHASES, LEADERS, GAPS, B.MESSAGES, LEDGER)


def positions(spark, sf):
    """Daily top three candidates as OPEN positions with their lens flags."""
    from ..operators.timeseries import add_gap_features
    ind = stored_indicators(spark, sf, "open", "high", "low", "close", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans import scorecard as P
    from .frames import sheet
    c = P.score_watchlist(sheet(spark, sf), indicators=ind, by=("date",), t=T).where(F.col("rank") <= 3)
    c = c.select("symbol", "date", "price", "target_price", "stop_price", "new_screeners", "score", "volume_pct")
    from ..functions.screeners import categorize_screener, normalize_screener
    fresh = F.coalesce(F.exists("new_screeners", lambda s: categorize_screener(normalize_screener(s)) == "breakout"), F.lit(False))
    flags = TR.leadership_history(ind, t=T).join(add_gap_features(ind, t=T).select("symbol", "date", "ep"), ["symbol", "date"])
    m = M.messages(spark, sf).where(X.is_admin(F.col("sender")))
    called = X.symbol_mentions(m, _symbols(spark, sf)).select("symbol", "date").distinct().withColumn("rw_admin", F.lit(True))
    df = c.join(flags, ["symbol", "date"]).join(called, ["symbol", "date"], "left")
    return df.select(
        "symbol", F.col("symbol").alias("name"), F.col("date").alias("entry_date"), F.col("price").alias("entry_price"), F.col("target_price").alias("target"),
        F.col("stop_price").alias("stop"), "persistent", "ep", "emerging", fresh.alias("fresh"), F.coalesce("rw_admin", F.lit(False)).alias("rw_admin"),
        F.lit("OPEN").alias("status"), F.lit(None).cast("date").alias("exit_date"), F.lit(None).cast("double").alias("exit_price"),
        F.lit(None).cast("double").alias("realized_pct"), F.lit(0.0).alias("peak_pct"), F.lit(0).alias("days_held"), F.col("price").alias("last_price"))


def ledger(spark, sf):
    return LG.resolve_positions(cut_lineage(positions(spark, sf), "positions"), M.bars(spark, sf), "2001-12-31", t=T)


def stored_ledger(spark, sf):
    return cut_lineage(ledger(spark, sf), "ledger")


@query("w28_ledger_bar_walk", LEDGER_SQL + " select symbol, entry_date, status, exit_date, exit_price, realized_pct, peak_pct, days_held, last_price from led")
def w28(spark, sf):
    return ledger(spark, sf).select("symbol", "entry_date", "status", "exit_date", "exit_price", "realized_pct", "peak_pct", "days_held", "last_price")


@query("j15_skip_open_symbols", LEDGER_SQL + """, o as (select distinct symbol from led where status = 'OPEN'), d as (select max(date) as d from live),
  nw as (select symbol, entry_date from led union all select symbol, (select d from d) from live where date = (select max(date) from live) and symbol not in (select symbol from o))
  select symbol, count(*) as n, max(entry_date) as newest from nw group by symbol""")
def j15(spark, sf):
    led = stored_ledger(spark, sf)
    c = candidates(spark, sf).select("symbol", "date", "price", "target_price", "stop_price")
    today = c.where(F.col("date") == c.agg(F.max("date")).scalar()).select(
        "symbol", F.col("date").alias("entry_date"), F.col("price").alias("entry_price"), F.lit("OPEN").alias("status"))
    return LG.add_picks(led, today).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("entry_date").alias("newest"))


_REPORT = ["win_rate", "avg_realized", "profit_factor", "open_unrealized", "open_peak"]
_REPORT_SQL = """ select count(*) as picks, count(*) filter (where status = 'OPEN') as open, count(*) filter (where status <> 'OPEN') as closed,
  count(*) filter (where status = 'TARGET') as target, count(*) filter (where status = 'STOPPED') as stopped, count(*) filter (where status = 'EXPIRED') as expired,
  avg((status = 'TARGET')::int) filter (where status <> 'OPEN') * 100 as win_rate, avg(realized_pct) as avg_realized,
  sum(realized_pct) filter (where realized_pct > 0) / -sum(realized_pct) filter (where realized_pct <= 0) as profit_factor,
  avg((last_price / entry_price - 1) * 100) filter (where status = 'OPEN') as open_unrealized, avg(peak_pct) filter (where status = 'OPEN') as open_peak from led"""


@query("a26_ledger_report", LEDGER_SQL + f", rep as ({_REPORT_SQL}) select picks, open, closed, target, stopped, expired, {pick(*_REPORT)} from rep")
def a26(spark, sf):
    return rounded(LG.ledger_report(ledger(spark, sf)), *_REPORT)


_LENSES = ", ".join(f"case when {n} then '{n}' end" for n in ("persistent", "ep", "emerging", "fresh", "rw_admin"))


@query("a26b_lens_report", LEDGER_SQL + f""", ul as (select status, realized_pct, unnest(list_filter([{_LENSES}, case when not (persistent or ep or emerging) then '(no lens)' end], lambda x: x is not null)) as lens from led where status <> 'OPEN')
  select lens, count(*) as n, round(avg((status = 'TARGET')::int) * 100, 6) as win_pct, round(avg(realized_pct), 6) as avg_realized from ul group by lens""")
def a26b(spark, sf):
    return rounded(LG.lens_report(ledger(spark, sf)), "win_pct", "avg_realized")


@query("a27_ledger_summary", LEDGER_SQL + f""", rep as ({_REPORT_SQL}), has as (select bool_or(persistent)::int + bool_or(ep)::int + bool_or(emerging)::int as lenses from led where status <> 'OPEN')
  select picks as total, open, closed, round_even(win_rate, 0)::int as win_rate, round(avg_realized, 2) as avg_realized, round(profit_factor, 2) as profit_factor,
    target, stopped, expired, round(open_unrealized, 2) as open_unrealized, lenses from rep, has""")
def a27(spark, sf):
    return LG.ledger_summary(stored_ledger(spark, sf)).withColumn("lenses", F.size("lens")).drop("lens")


@query("a34_ledger_context", LEDGER_SQL + """ select symbol, arg_max(status, entry_date) as status, max(entry_date) as entry_date, round((arg_max(last_price / entry_price, entry_date) - 1) * 100, 1) as unreal,
  arg_max(days_held, entry_date) as days from led group by symbol""")
def a34(spark, sf):
    return LG.symbol_status(ledger(spark, sf)).select("symbol", "ledger.status", "ledger.entry_date", "ledger.unreal", "ledger.days")


@query("a34b_ledger_alerts", LEDGER_SQL + """ select symbol, entry_date, case when status <> 'OPEN' then lower(status) when (target - last_price) / last_price <= 0.03 then 'near-target' else 'near-stop' end as kind
  from led where status <> 'OPEN' or (target - last_price) / last_price <= 0.03 or (last_price - stop) / last_price <= 0.03""")
def a34b(spark, sf):
    return LG.ledger_alerts(stored_ledger(spark, sf), t=T).drop("detail")


@query("a34c_open_positions", LEDGER_SQL + " select symbol, entry_date, round((last_price / entry_price - 1) * 100, 1) as unreal, peak_pct, days_held from led where status = 'OPEN'")
def a34c(spark, sf):
    return LG.open_positions(ledger(spark, sf)).select("symbol", "entry_date", "unreal", "peak_pct", "days_held")


# ---- triage ---------------------------------------------------------------------------

TRIAGE = """
tday as (select max(date) as d from live where date <= date '@DAY'), tprev as (select max(date) as d from live where date < (select d from tday)),
tri as (
  select f.symbol, f.rank, f.score, f.tier, f.phase, f.fresh, f.vol_ok, f.lagging, not f.calm as extended, f.sector, round(f.rs_vs_market, 1) as rs, coalesce(s.leader_days, 0) as leader_days,
    coalesce(s.leader_days >= 12, false) as persistent, p.symbol is null as is_new, f.score - p.score as score_delta, p.rank - f.rank as rank_delta, coalesce(m.mentions, 0) as mentions,
    coalesce(m.admin_mentions, 0) as mention_admin, f.price, f.target_price, f.stop_price
  from flags f left join strips s on s.symbol = f.symbol left join (select * from live where date = (select d from tprev)) p on p.symbol = f.symbol
  left join stats m on m.symbol = f.symbol where f.date = (select d from tday) and f.rank <= 60)""".replace("@DAY", SHEET_DAY)
TRIAGE_SQL = B.with_(B.SHEET, B.INDICATORS, RISK, NOTES, PHASES, LEADERS, STRIP, B.MESSAGES, _mention_sql(SHEET_DAY), TRIAGE)


def triage(spark, sf):
    today, before = _last_two_sheets(spark, sf)
    ind = indicators(spark, sf)
    series = M.bars(spark, sf).where(F.col("date") == today.agg(F.max("date")).scalar()).select(
        "symbol", F.when(F.col("volume") >= 100000, "EQ").otherwise("BE").alias("series"))
    mentions = X.group_mentions(M.messages(spark, sf), today.select("symbol"), SHEET_DAY, t=T)
    rows = TR.triage_rows(today, leaders=TR.leadership(ind, SHEET_DAY, t=T), series=series, mentions=mentions, previous=before, t=T)
    return cut_lineage(rows, "triage")


@query("t01_triage_rows", TRIAGE_SQL + " select symbol, rank, score, tier, phase, fresh, vol_ok, rs, leader_days, persistent, is_new, score_delta, rank_delta, mentions from tri")
def t01(spark, sf):
    return triage(spark, sf).select("symbol", "rank", "score", "tier", "phase", "fresh", "vol_ok", "rs", "leader_days", "persistent", "is_new",
                                    "score_delta", "rank_delta", "mentions")


@query("a30_triage_meta", TRIAGE_SQL + """ select count(*) as shown, count(*) filter (where tier = 'A') as tier_a, count(*) filter (where tier = 'B') as tier_b, count(*) filter (where fresh) as fresh_count,
  round(median(rs) filter (where rank <= 10), 6) as median_rs_top10, count(*) filter (where persistent) as persistent_count, count(*) filter (where mentions > 0) as mention_count,
  count(*) filter (where is_new) as new_count, (select count(*) from live) as total_gated from tri""")
def a30(spark, sf):
    total = candidates(spark, sf).agg(F.count(F.lit(1)))
    meta = TR.triage_meta(triage(spark, sf), total)
    return rounded(meta.select("shown", "tier_a", "tier_b", "fresh_count", "median_rs_top10", "persistent_count", "mention_count", "new_count", "total_gated"), "median_rs_top10")


@query("a31_sheet_changes", TRIAGE_SQL + """, p as (select * from live where date = (select d from tprev)),
  dropped as (select 'dropped' as list, symbol, rank as rank_before, null::int as score_delta from p where symbol not in (select symbol from tri) order by rank, symbol limit 20),
  movers as (select 'mover' as list, symbol, rank_delta + rank as rank_before, score_delta from tri where score_delta <> 0 order by abs(score_delta) desc, rank limit 12)
  select * from dropped union all select * from movers""")
def a31(spark, sf):
    today, before = _last_two_sheets(spark, sf)
    diff = TR.sheet_diff(today.where(F.col("rank") <= T.triage_rows), before)
    return TR.diff_report(diff).select("list", "symbol", "rank_before", "score_delta")


@query("p05_triage_view", TRIAGE_SQL + """ select symbol, rank, tier, rs from tri where tier <> 'A' and vol_ok and not lagging and rs >= -50 and symbol like '%SYM%' and symbol not in ('SYMB')""")
def p05(spark, sf):
    v = V.view(triage(spark, sf), tier_a=False, vol=True, nolag=True, min_rs=-50.0, query="sym", dismissed=["SYMB"], sort_key="rs", descending=True)
    return v.select("symbol", "rank", "tier", "rs")


@query("p06_setup_presets", TRIAGE_SQL + """ select 'lps' as setup, symbol from tri where phase = 'LPS' and not extended and not lagging and rs >= 5
  union all select 'sos', symbol from tri where phase = 'SOS' and fresh and vol_ok and not extended and not lagging and rs >= 5 and tier <> 'C'
  union all select '', symbol from tri""")
def p06(spark, sf):
    rows = triage(spark, sf)
    out = None
    for setup in ("lps", "sos", ""):
        part = rows.where(V.view_filter(V.view_params(setup))).select(F.lit(setup).alias("setup"), "symbol")
        out = part if out is None else out.unionByName(part)
    return out


@query("p07_private_columns", TRIAGE_SQL + " select symbol, rank, 0 as private_columns from tri")
def p07(spark, sf):
    public = V.public_columns(triage(spark, sf))
    private = [c for c in public.columns if c.startswith(("mention", "call_")) or c == "ledger"]
    return public.select("symbol", "rank", F.lit(len(private)).alias("private_columns"))


@query("p08_fund_buys", B.with_(B.BARS, B.DEALS) + """ select symbol, date, client, quantity from deals where side = 'BUY'
  and not (upper(client) like '%SUPPLIER#00000000%' or upper(client) like '%R#000000011%')""")
def p08(spark, sf):
    from .evaluation_q import DESKS
    return RS.fund_buys(M.deals(spark, sf), [d.upper() for d in DESKS]).select("symbol", "date", "client", "quantity")


@query("t03_strength_ladder", TRIAGE_SQL + " select symbol, score, rs from (select * from tri order by score desc, symbol limit 10) where rs is not null")
def t03(spark, sf):
    return TR.strength_ladder(triage(spark, sf)).select("symbol", "score", "rs")


@query("t04_ledger_picks", TRIAGE_SQL + f""" select date '{SHEET_DAY}' as entry_date, symbol, price as entry_price, {exact_round('target_price', 2)} as target,
  {exact_round('stop_price', 2)} as stop, score, rs, tier, persistent, fresh, 'OPEN' as status from tri where rank <= 10""")
def t04(spark, sf):
    picks = LG.picks_from_triage(triage(spark, sf), SHEET_DAY, top=10)
    return picks.select("entry_date", "symbol", "entry_price", "target", "stop", "score", "rs", "tier", "persistent", "fresh", "status")


# ---- cohorts --------------------------------------------------------------------------

COHORTS = RESOLVED + "," + PERSIST + "," + GAPS + """,
cf as (select r.*, p.persist20, g.gap_pct, g.rel_volume as rvol, g.rs_vs_market as rs_ohlc from resolved r left join persist p on p.symbol = r.symbol and p.date = r.date
  left join gaps g on g.symbol = r.symbol and g.date = r.date),
c0 as (
  select 'uc1' as cohort, score::double as sort_value, * from cf where rank <= 10
  union all select 'uc2', score, * from cf where rank <= 40 and persist20 >= 12
  union all select 'uc3', score, * from cf where rank <= 40 and persist20 >= 12 and has_breakout_pattern and len(new_screeners) > 0
  union all select 'uc3_any', score, * from cf where rank <= 40 and persist20 >= 12 and has_breakout_pattern
  union all select 'uc4', rvol, * from cf where rank <= 40 and gap_pct >= 4 and rvol >= 3
  union all select 'uc5', score, * from cf where rank <= 40 and rule_phase = 'Breakout Trigger'
  union all select 'uc6', score, * from cf where rank <= 40 and rule_phase = 'Rebound Setup'
  union all select 'uc7', rvol, * from cf where rvol >= 3 and rs_ohlc between 0 and 25 and score >= 50
  union all select 'anti1', score, * from cf where score >= 75 and coalesce(persist20, 0) <= 2
  union all select 'anti2', deliv_per, * from cf where rank <= 40 and deliv_per >= 80),
c1 as (select * replace (case when cohort = 'uc3_any' then 'uc3' else cohort end as cohort) from c0
   where cohort <> case when (select count(*) from c0 where cohort = 'uc3') < 5 then 'uc3' else 'uc3_any' end)"""
COHORT_SQL = B.with_(B.SCORED, COHORTS)


def _cohort_rows(spark, sf):
    ind = stored_indicators(spark, sf, "open", "high", "low", "close", "rs_vs_market", "atr_pct", "rel_volume")
    from ..plans.scorecard import labeled_history
    from .frames import sheet
    frame = cut_lineage(CO.cohort_frame(labeled_history(sheet(spark, sf), ind, t=T), ind, t=T), "cohorts")
    return CO.with_fallback(CO.cohort_rows(frame, t=T))


@query("a29_cohorts", COHORT_SQL + " select cohort, count(*) as n_rows, count(distinct symbol) as n_symbols, round(avg(win) * 100, 6) as win_rate, round(avg(touch) * 100, 6) as touch_rate from c1 group by cohort")
def a29(spark, sf):
    return rounded(CO.cohort_rates(_cohort_rows(spark, sf)), "win_rate", "touch_rate")


@query("a28_cohort_examples", COHORT_SQL + """, best as (select *, row_number() over (partition by cohort, symbol order by sort_value desc, date) as r1 from c1),
  pl as (select *, row_number() over (partition by cohort, win order by sort_value desc, symbol)::int as place from best where r1 = 1)
  select cohort, symbol, date, win, place, score, round(future_max_30d, 6) as future_max_30d from pl
  where place <= case when cohort in ('anti1', 'anti2') then case when win = 1 then 2 else 3 end else case when win = 1 then 3 else 2 end end""")
def a28(spark, sf):
    e = CO.cohort_examples(_cohort_rows(spark, sf))
    return e.select("cohort", "symbol", "date", "win", "place", "score", F.round("future_max_30d", 6).alias("future_max_30d"))


# ---- streams --------------------------------------------------------------------------

def _events_stream(spark, sf):
    """The events table as a file stream."""
    schema = M.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("st1_message_ingest", B.with_(B.MESSAGES) + """ select m.group_id, count(*) as n, count(distinct m.message_id) as distinct_ids, max(m.message_id) as last_id from messages m group by m.group_id""")
def st1(spark, sf):
    out, ckpt = shared_folder(spark, "messages"), shared_folder(spark, "messages-checkpoint")
    stream = M.messages_with_time(_events_stream(spark, sf))
    # Every message is delivered twice, and once more as a blank.
    again = stream.withColumn("text", F.explode(F.array(F.col("text"), F.col("text"), F.lit("  "))))
    SM.ingest_messages(again, out, ckpt).awaitTermination()
    t = spark.read.parquet(out)
    return t.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("message_id").alias("distinct_ids"), F.max("message_id").alias("last_id"))


@query("st1b_mention_windows", B.with_(B.MESSAGES) + """, x as (select e.ts, regexp_extract(m.text, '(SYM[A-Z])', 1) as symbol, regexp_full_match(m.sender, '-?[0-9]+') as admin from messages m join events e on e.event_id = m.message_id),
  w as (select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as window_start, symbol, count(*) as mentions, count(*) filter (where admin) as admin_mentions from x group by all)
  select window_start, window_start + interval 1 day as window_end, symbol, mentions, admin_mentions from w""")
def st1b(spark, sf):
    out, ckpt = shared_folder(spark, "windows"), shared_folder(spark, "windows-checkpoint")
    windows = SM.mention_windows(M.messages_with_time(_events_stream(spark, sf)), M.listed_companies(spark, sf), window="1 day")
    SM.run_updates(windows, out, ckpt)
    return SM.latest_rows_of(spark, out, ("window_start", "window_end", "symbol"))


def _ledger_revisions(spark, sf, parts, **options):
    """Newest results of the ledger stream after ``parts`` of the events were delivered one after the other."""
    src, out, ckpt = (shared_folder(spark, p) for p in ("ledger-events", "ledger-revisions", "ledger-checkpoint"))
    events = cut_lineage(SL.ledger_events(positions(spark, sf), M.bars(spark, sf)), "events")
    for part in parts:
        events.where(part).write.mode("append").parquet(src)
        SM.run_to_table(SL.ledger_stream(spark.readStream.schema(SL.EVENT_SCHEMA).parquet(src), t=T, **options), out, ckpt)
    return SL.latest_results(spark.read.schema(SL.RESULT_SCHEMA).parquet(out))


_RESULT = "symbol, entry_date, status, exit_date, exit_price, realized_pct, peak_pct, days_held"


@query("st2_ledger_stream", LEDGER_SQL + f" select {_RESULT} from led where status <> 'OPEN'")
def st2(spark, sf):
    # Bars of every third month come late, and half of the picks after most of their bars.
    late, odd = F.col("kind").eqNullSafe("bar") & (F.month("date") % 3 == 0), F.year("date") % 2 == 1
    pick = F.col("kind") == "pick"
    parts = (~late & ~(pick & odd), pick & odd, late)
    return _ledger_revisions(spark, sf, parts).where("status != 'OPEN'").select(*_RESULT.split(", "))


@query("st2b_ledger_open_symbols", LEDGER_SQL.replace("with ", "with recursive ", 1) + f""", taken as (
  select symbol, entry_date, exit_date from led where (symbol, entry_date) in (select (symbol, min(entry_date)) from led group by symbol)
  union all
  select l.symbol, l.entry_date, l.exit_date from led l join (
    select a.symbol, min(n.entry_date) as d from taken a join led n on n.symbol = a.symbol and n.entry_date > a.exit_date group by a.symbol) x
  on x.symbol = l.symbol and x.d = l.entry_date)
  select {_RESULT} from led join taken using (symbol, entry_date, exit_date) where status <> 'OPEN'
  union all select symbol, entry_date, 'SKIPPED', null, null, null, 0.0, 0 from led anti join taken using (symbol, entry_date)""")
def st2b(spark, sf):
    early = F.year("date") < 1996
    parts = (early | (F.col("kind") == "pick"), ~early & (F.col("kind") == "bar"))
    return _ledger_revisions(spark, sf, parts, skip_open=True).where("status != 'OPEN'").select(*_RESULT.split(", "))


@query("st3_stream_upsert", B.with_(B.BARS) + """ select year(date)::int as y, count(*) as n, count(*) filter (where day(date) > 15) as corrected,
  sum(case when day(date) > 15 then volume + 1 else volume end)::bigint as volume from bars group by y""")
def st3(spark, sf):
    src, out, ckpt = (shared_folder(spark, p) for p in ("late-bars", "bars-table", "upsert-checkpoint"))
    b = M.bars(spark, sf).select("symbol", F.col("date").alias("day"), "volume").withColumns(
        {"date": F.trunc("day", "month"), "version": F.lit(1)})
    late = b.where(F.day("day") > 15).withColumns({"volume": F.col("volume") + 1, "version": F.lit(2)})
    for part in (b, b.unionByName(late), b.unionByName(late)):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(part.schema).parquet(src)
        SU.upsert_dates(stream, out, ckpt, keys=("symbol", "day", "date")).awaitTermination()
    return spark.read.parquet(out).groupBy(F.year("day").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("version") == 2).alias("corrected"), F.sum("volume").alias("volume"))
