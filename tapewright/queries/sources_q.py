"""Scans, conformance and sinks (S rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import pct_move
from ..functions.screeners import screener_name_from_stem
from ..operators import sheets as SH
from ..operators.timeseries import by_symbol
from ..session import cut_lineage, shared_folder
from ..sources import files as FI
from ..sources import market_tables as M
from ..sources import tables as TB
from . import blocks as B
from .registry import query

R = 6


def _raw_bars(spark, sf):
    """Bars as a vendor writes them: padded text, thousands commas, mixed series."""
    b = M.bars(spark, sf)
    series = F.when(F.col("volume") >= 100000, "EQ").when(F.col("volume") >= 50000, "BE ").when(
        F.col("volume") >= 5000, " BZ").otherwise("SM")
    text = [F.concat(F.lit(" "), F.col(c).cast("string")).alias(n) for c, n in
            (("open", "OPEN_PRICE"), ("high", "HIGH_PRICE"), ("low", "LOW_PRICE"), ("close", "CLOSE_PRICE"))]
    return b.select(
        F.concat(F.lit(" "), F.col("symbol"), F.lit(" ")).alias("Symbol"), series.alias("SERIES"), *text,
        F.format_number("volume", 0).alias("TTL_TRD_QNTY"),
        F.when(F.col("deliv_per") == 0, "-").otherwise(F.col("deliv_per").cast("string")).alias("DELIV_PER"), "date")


def _write_files(df, path, *, mode="append"):
    """CSV files under ``path``, one per value of the column ``file``, which is their name."""
    df.repartition("file").write.partitionBy("file").option("header", True).mode(mode).csv(path)


def _dated_name(form, prefix="sheet_", suffix=""):
    return F.concat(F.lit(prefix), F.date_format("date", form), F.lit(suffix))


_PANEL = ("select symbol, date, {x} open, high, low, close, volume::double as volume, "
          "case when deliv_per = 0 then null else round(deliv_per, 6) end as deliv_per from bars where volume >= 5000")


@query("s01_bar_file_scan", B.with_(B.BARS) + " select symbol, date, close, volume::double as volume from bars")
def s01(spark, sf):
    path = shared_folder(spark, "bars")
    raw = M.bars(spark, sf).select(
        F.col("symbol").alias("SYMBOL"), F.lit("EQ").alias(" SERIES"),
        F.col("close").cast("string").alias(" CLOSE_PRICE"), F.format_number("volume", 0).alias("TTL_TRD_QNTY"),
        _dated_name("ddMMyyyy", "bars_").alias("file"))
    _write_files(raw, path)
    out = FI.conform_bars(FI.read_bar_files(spark, [path]))
    return out.select("symbol", "date", "close", "volume")


@query("s02_bar_conform", B.with_(B.BARS) + " " + _PANEL.format(
    x="case when volume >= 100000 then 'EQ' when volume >= 50000 then 'BE' else 'BZ' end as series,"))
def s02(spark, sf):
    return FI.conform_bars(_raw_bars(spark, sf)).withColumn("deliv_per", F.round("deliv_per", R)).drop("deliv_qty")


@query("s03_panel_build", B.with_(B.BARS) + " " + _PANEL.format(x=""))
def s03(spark, sf):
    raw = _raw_bars(spark, sf)
    # A first, wrong copy of every bar, and rows without a usable close, must lose.
    stale = raw.withColumns({"CLOSE_PRICE": F.lit("1"), "_seq": F.lit(1)})
    unusable = raw.withColumns({"CLOSE_PRICE": F.lit("0"), "_seq": F.lit(3)})
    everything = raw.withColumn("_seq", F.lit(2)).unionByName(stale).unionByName(unusable)
    panel = FI.build_panel(FI.conform_bars(everything), order="_seq")
    return panel.drop("series", "deliv_qty").withColumn("deliv_per", F.round("deliv_per", R))


@query("s04_source_preference", B.with_(B.BARS) + """
  select symbol, date, close, case when month(date) <= 6 then 0 else 1 end as source from bars""")
def s04(spark, sf):
    b = M.bars(spark, sf).select("symbol", "date", "close")
    first = b.where(F.month("date") <= 6).withColumns({"source": F.lit(0), "_priority": F.lit(0)})
    second = b.withColumns({"source": F.lit(1), "_priority": F.lit(1)})
    return FI.prefer_source(first.unionByName(second))


# Sheets' files hold a month each, under its first day: a file costs more to write than its rows.

@query("s05_canonical_file_names", B.with_(B.BARS) + """
  select date_trunc('month', date)::date as date, count(*) as n, case when month(date) <= 5 then 'compact' else 'iso' end as name_form
  from bars group by 1, 3""")
def s05(spark, sf):
    path = shared_folder(spark, "sheets")
    b = M.bars(spark, sf).select("symbol", F.trunc("date", "month").alias("date"))
    # Every month has two files with times in their names, which hold its rows once more; most have an ISO or a compact name, too.
    timed = [b.withColumn("file", _dated_name("yyyy-MM-dd", suffix=t)) for t in (" 0915.csv", " 1530.csv")]
    iso = b.where(F.month("date") <= 10).withColumn("file", _dated_name("yyyy-MM-dd"))
    compact = b.where(F.month("date") <= 5).withColumn("file", _dated_name("ddMMyyyy"))
    _write_files(timed[0].unionByName(timed[1]).unionByName(iso).unionByName(compact).drop("date"), path)
    rows = FI.read_dated(spark, [path])
    form = F.when(FI.has_canonical_name(F.col("_path")), "compact").otherwise("iso")
    return rows.groupBy("date", form.alias("name_form")).agg(F.count(F.lit(1)).alias("n"))


def _raw_sheet(spark, sf):
    b = M.bars(spark, sf).withColumn("chg", pct_move(F.lag("close").over(by_symbol()), F.col("close")))
    d = SH.deals_by_kind(M.deals(spark, sf))
    return b.join(d, ["symbol", "date"], "left").select(
        "date", F.col("symbol").alias("Symbol"), F.col("close").cast("string").alias("Price"),
        F.concat(F.col("chg").cast("string"), F.lit("%")).alias("% Chg"),
        F.when(F.col("close") > 0, F.col("volume").cast("string")).alias("Volume"),
        F.col("bulk_buy_quantity").cast("string").alias("BUY_quantity_x"),
        F.col("block_buy_quantity").cast("string").alias("BUY_quantity_y"),
        F.col("bulk_sell_quantity").cast("string").alias("SELL_quantity_x"),
        F.col("block_sell_quantity").cast("string").alias("SELL_quantity_y"))


_SHEET_SQL = B.with_(B.BARS, B.DEALS) + """, ds as (
  select symbol, date, sum(case when kind='bulk' and side='BUY' then quantity else 0.0 end) bb,
    sum(case when kind='block' and side='BUY' then quantity else 0.0 end) kb,
    sum(case when kind='bulk' and side='SELL' then quantity else 0.0 end) bs,
    sum(case when kind='block' and side='SELL' then quantity else 0.0 end) ks,
    count(*) filter (where kind='bulk') nb, count(*) filter (where kind='block') nk from deals group by symbol, date)
  select b.symbol, b.date, b.close as price, b.volume::double as volume,
    round((b.close / lag(b.close) over (partition by b.symbol order by b.date) - 1) * 100, 3) as chg,
    case when nb > 0 then bb when nk > 0 then kb end as buy_quantity,
    case when nb > 0 then bs when nk > 0 then ks end as sell_quantity,
    (null::varchar) as sector
  from bars b left join ds on ds.symbol = b.symbol and ds.date = b.date"""


def _sheet_out(df):
    return df.select(
        F.col("Symbol").alias("symbol"), "date", F.col("Price").alias("price"), F.col("Volume").alias("volume"),
        F.round("chg", 3).alias("chg"), F.col("BUY_quantity").alias("buy_quantity"),
        F.col("SELL_quantity").alias("sell_quantity"), F.col("Sector").alias("sector"))


@query("s06_sheet_conform", _SHEET_SQL)
def s06(spark, sf):
    return _sheet_out(FI.conform_sheet(_raw_sheet(spark, sf)))


@query("s07_sheet_history_union", _SHEET_SQL.replace("b.date, b.close as price", "date_trunc('month', b.date)::date as date, b.close as price"))
def s07(spark, sf):
    root, work = shared_folder(spark, "sheets-root"), shared_folder(spark, "sheets-work")
    raw = cut_lineage(_raw_sheet(spark, sf).withColumn("date", F.trunc("date", "month")), "raw-sheet")
    priceless = raw.withColumn("Price", F.lit("n/a"))
    wrong = raw.withColumn("Price", F.lit("1"))
    first = F.month("date") <= 6
    # Half of the dates are in the first directory; the second has them, too, and the others under two forms of the name.
    _write_files(raw.where(first).unionByName(priceless.where(first)).withColumn("file", _dated_name("ddMMyyyy")).drop("date"), root)
    _write_files(wrong.where(first).withColumn("file", _dated_name("ddMMyyyy")).drop("date"), work)
    _write_files(raw.where(~first).withColumn("file", _dated_name("ddMMyyyy")).drop("date"), work)
    _write_files(wrong.where(~first).withColumn("file", _dated_name("yyyy-MM-dd")).drop("date", "% Chg"), work)
    return _sheet_out(FI.read_sheet_files(spark, [root, work]))


def _vendor_hits(spark, sf):
    """Screener-file rows under a vendor's headers."""
    q = M.bars(spark, sf).select("symbol", "date", "close", "volume")
    return M.screener_hits(spark, sf).join(q, ["symbol", "date"]).select(
        F.col("symbol").alias("nsecode"), F.concat(F.col("symbol"), F.lit(" Ltd")).alias("name"),
        F.format_number("close", 2).alias("close"), F.format_number("volume", 0).alias("volume"),
        F.lit("1.5%").alias("%_change"), F.date_format("date", "yyyy-MM-dd").alias("Day"), "screener")


_VENDOR_SQL = B.with_(B.BARS, B.HITS) + """
  select h.symbol, h.date, h.screener, h.symbol || ' Ltd' as stock_name, 1.5::double as chg, b.close as price,
    b.volume::double as volume from hits h join bars b on b.symbol = h.symbol and b.date = h.date"""


@query("s08_column_aliases", _VENDOR_SQL)
def s08(spark, sf):
    path = shared_folder(spark, "screener-files")
    hits = cut_lineage(_vendor_hits(spark, sf), "vendor-hits")
    file = F.concat("screener", F.when(F.month("Day") % 2 == 0, "_20260706_093000.csv").otherwise("_20260706_160000.csv"))
    plain = hits.where(F.month("Day") % 2 == 0).withColumn("file", file).drop("screener")
    _write_files(plain, path)
    # The other files have other headers in another order.
    titled = hits.where(F.month("Day") % 2 == 1).withColumn("file", file).select(
        F.col("volume").alias("Volume"), "Day", F.col("nsecode").alias("SYMBOL"), F.col("%_change").alias("% Chg"),
        F.col("close").alias("Price"), F.col("name").alias("Stock Name"), "file")
    _write_files(titled, path)
    found = FI.conform_hits(FI.read_csv_by_name(spark, path, aliases=True), "Day")
    return found.withColumn("date", FI.parse_date(F.col("Day"))).drop("Day", "_path")


@query("s09_screener_from_stem", B.with_(B.BARS, B.HITS) + """
  select screener, count(*) as n, screener || '_tail' as plain_stem from hits group by screener""")
def s09(spark, sf):
    stems = M.screener_hits(spark, sf).groupBy("screener").agg(F.count(F.lit(1)).alias("n"))
    stamped = screener_name_from_stem(F.concat(F.col("screener"), F.lit("_20260706_093000")))
    plain = screener_name_from_stem(F.concat(F.col("screener"), F.lit("_tail_part")))
    return stems.select(stamped.alias("screener"), "n", plain.alias("plain_stem"))


@query("s10_screener_folder_date", B.with_(B.BARS, B.HITS) + """
  select date, count(*) as n, count(distinct screener) as screeners from hits group by date""")
def s10(spark, sf):
    hits = M.screener_hits(spark, sf).withColumn(
        "_path", F.concat(F.lit("in/"), F.date_format("date", "yyyy-MM-dd"), F.lit("/merged.csv"))).drop("date")
    return FI.with_folder_date(hits).groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("screener").alias("screeners"))


@query("s11_delivery_conform", B.with_(B.BARS) + """
  select symbol, date, nullif(deliv_qty, 0) as deliv_qty, case when deliv_per = 0 then null else round(deliv_per, 6) end as deliv_per
  from bars""")
def s11(spark, sf):
    b = M.bars(spark, sf)
    raw = b.select(
        "symbol", F.date_format("date", " dd-MMM-yyyy").alias("Date"), F.lit("EQ").alias("SERIES"),
        F.when(F.col("deliv_qty") == 0, " -").otherwise(F.col("deliv_qty").cast("string")).alias("DELIV_QTY"),
        F.when(F.col("deliv_per") == 0, "-").otherwise(F.col("deliv_per").cast("string")).alias("DELIV_PER")
    ).withColumnRenamed("symbol", "Symbol")
    return FI.conform_delivery(raw).select("symbol", "date", "deliv_qty", F.round("deliv_per", R).alias("deliv_per"))


@query("s12_deals_conform", B.with_(B.BARS, B.DEALS) + """
  select symbol, date, side, client, count(*) as n, sum(quantity) as quantity from deals group by all""")
def s12(spark, sf):
    d = M.deals(spark, sf)
    raw = d.select(
        F.date_format("date", "dd-MMM-yyyy").alias("Date"), F.concat("symbol", F.lit(" ")).alias("Symbol"),
        F.initcap("side").alias("Buy/Sell"), F.col("quantity").cast("string").alias("Quantity Traded"),
        F.col("client").alias("Client Name"))
    placeholder = raw.withColumn("Date", F.when(F.col("Buy/Sell") == "Buy", " No Records").otherwise("soon"))
    out = FI.conform_deals(raw.unionByName(placeholder))
    return out.groupBy("symbol", "date", "side", "client").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("s13_bar_header_normalize", B.with_(B.BARS) + " select symbol, strftime(date, '%d-%b-%Y') as date1, close from bars")
def s13(spark, sf):
    raw = M.bars(spark, sf).select(
        F.concat(F.lit(" "), F.col("symbol")).alias("SYMBOL"),
        F.date_format("date", "dd-MMM-yyyy ").alias("DATE1"), "close")
    n = FI.normalize_bar_headers(raw)
    return n.select(F.col("Symbol").alias("symbol"), F.col("Date").alias("date1"), "close")


@query("s14_replace_dates", B.with_(B.BARS) + """
  select year(date)::int as y, count(*) as n, cast(count(*) filter (where year(date) >= 1999) as bigint) as corrected,
    sum(volume)::bigint as volume from bars group by y""")
def s14(spark, sf):
    path = shared_folder(spark, "bars-by-date")
    b = M.bars(spark, sf).select("symbol", "volume", F.trunc("date", "year").alias("date"))
    TB.replace_dates(b.withColumn("corrected", F.lit(False)), path)
    late = b.where(F.year("date") >= 1999).withColumn("corrected", F.lit(True))
    TB.replace_dates(late, path)
    TB.replace_dates(late, path)
    return spark.read.parquet(path).groupBy(F.year("date").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("corrected").alias("corrected"), F.sum("volume").alias("volume"))


@query("s15_point_read", B.with_(B.BARS, B.HITS) + """
  select symbol, screener from hits where date = (select max(date) from bars)""")
def s15(spark, sf):
    newest = M.bars(spark, sf).agg(F.max("date")).first()[0]
    return FI.on_date(M.screener_hits(spark, sf), newest).select("symbol", "screener")


@query("s16_latest_and_previous_sheet", B.with_(B.BARS) + """, d as (select max(date) as m from bars),
  p as (select max(date) as m from bars where date < (select m from d))
  select symbol, date, close, date = (select m from d) as is_latest from bars
  where date in ((select m from d), (select m from p))""")
def s16(spark, sf):
    b = M.bars(spark, sf).select("symbol", "date", "close")
    newest = b.agg(F.max("date")).first()[0]
    return FI.latest_rows(b).withColumn("is_latest", F.lit(True)).unionByName(
        FI.latest_rows(b, before=newest).withColumn("is_latest", F.lit(False)))


@query("s17_latest_series", B.with_(B.BARS) + """
  select symbol, case when volume >= 100000 then 'EQ' when volume >= 50000 then 'BE' else 'BZ' end as series
  from bars where volume >= 5000 and date = (select max(date) from bars where volume >= 5000)""")
def s17(spark, sf):
    return FI.latest_series(FI.conform_bars(_raw_bars(spark, sf)))


@query("s18_csv_sink", B.with_(B.BARS) + " select symbol, date, close, volume from bars")
def s18(spark, sf):
    path = shared_folder(spark, "panel-csv")
    b = M.bars(spark, sf).select("symbol", "date", "close", "volume")
    TB.write_csv(b, path)
    return spark.read.schema(b.schema).csv(path, header=True)


@query("s19_json_sink", B.with_(B.BARS, B.HITS) + """
  select symbol, date, array_to_string(list_sort(list(screener)), ',') as screeners from hits group by symbol, date""")
def s19(spark, sf):
    path = shared_folder(spark, "rows-json")
    rows = SH.merge_hits(M.screener_hits(spark, sf), ("symbol", "date"))
    TB.write_json(rows, path)
    back = spark.read.schema("symbol string, date date, screeners array<string>").json(path)
    return back.withColumn("screeners", F.array_join("screeners", ","))


@query("s20_screener_weights", B.with_(B.SHEET) + " select symbol, date, pattern_points, pattern_points as from_map from points")
def s20(spark, sf):
    names = M.screener_hits(spark, sf).select("screener").distinct()
    built_in = TB.builtin_weights()
    from ..functions.screeners import normalize_screener, pattern_score
    w = names.withColumn("weight", F.try_element_at(built_in, normalize_screener(F.col("screener")))).dropna()
    table = TB.clean_weights(w.withColumn("_i", F.lit(1)).unionByName(
        w.withColumns({"weight": F.lit(99), "_i": F.lit(0)})), "_i")
    merged = SH.merge_hits(M.screener_hits(spark, sf), ("symbol", "date"))
    out = TB.add_pattern_points(merged, table)
    return out.select("symbol", "date", "pattern_points",
                      pattern_score(F.col("screeners"), built_in).alias("from_map"))


@query("s21_message_high_water", B.with_(B.MESSAGES) + """
  , cut as (select group_id, max(message_id) as last_id from messages where date < date '1998-01-01' group by group_id)
  select m.group_id, count(*) as n_new, min(message_id) as first_new, max(message_id) as last_new
  from messages m join cut c on c.group_id = m.group_id where message_id > last_id group by m.group_id""")
def s21(spark, sf):
    m, log = M.messages(spark, sf), shared_folder(spark, "message-log")
    TB.append_messages(spark, m.where(F.col("date") < F.lit("1998-01-01").cast("date")), log)
    # Re-delivered and blank messages are part of the input and must not appear.
    blank = m.withColumns({"text": F.lit("  "), "message_id": F.col("message_id") + 10_000_000})
    TB.append_messages(spark, m.unionByName(m).unionByName(blank), log, "news")
    fresh = spark.read.parquet(f"{log}/batch=news")
    return fresh.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_new"), F.min("message_id").alias("first_new"), F.max("message_id").alias("last_new"))
