"""Market tables derived by Spark from the star-schema tables (lineitem, part, ...).

They give every operator whole-table input of a realistic shape: bars, screener hits,
deals, messages, sectors.  Prices come from whole cents so that they are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timeseries import by_symbol

BENCHMARK = "SYMA"

# Order priority and status -> screener name as a data vendor writes it.
SCREENER_OF_CODE = {
    "1-URGENT|F": "Premium_7.1",
    "1-URGENT|O": "RT_52W_BREAKOUT",
    "1-URGENT|P": "DARVAS",
    "2-HIGH|F": "RSI_IN_ALL_TF_65",
    "2-HIGH|O": "RT_Range_Breakout_with_Volume",
    "2-HIGH|P": "RT_MAJOR_SUPPORT",
    "3-MEDIUM|F": "VCP",
    "3-MEDIUM|O": "RT_Daily_Contraction",
    "3-MEDIUM|P": "PREMIUM_3 FOR-MOMENTUM",
    "4-NOT SPECIFIED|F": "RT_Fib_0.7_to_0.88_Zone",
    "4-NOT SPECIFIED|O": "RT_MOMENTUM_MONSTERS",
    "4-NOT SPECIFIED|P": "RT_COP_STRATEGY",
    "5-LOW|F": "RT_READY_TO_REBOUND_20260713",
    "5-LOW|O": "RT_SIDEWAY_BREAKOUT",
    "5-LOW|P": "GEM SWING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")


def symbol_of_brand(number: Column) -> Column:
    return F.concat(F.lit("SYM"), F.chr(number + 64))


def _trades(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """lineitem rows with their symbol and trade date; only the named columns are read."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", symbol_of_brand(_brand_number()).alias("symbol"))
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("date"), *columns)
    return items.join(part, items.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")


def _finite(cents: Column) -> Column:
    """Null beyond the range of a double."""
    return F.when(cents < float("inf"), cents)


def _whole(cents: Column) -> Column:
    """``floor`` as a double; from 2^53 on every double is whole, and may not fit a long."""
    return _finite(F.when(cents < 2.0 ** 53, F.floor(cents).cast("double")).otherwise(cents))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OHLCV row per symbol and date.

    Cents stay doubles: a level is the sum of all ticks so far, so with many trades a day its price outgrows a long.
    """
    cents = F.round(F.col("l_discount") * 100).cast("long") - 5
    tax = F.round(F.col("l_tax") * 100).cast("long")
    day = (
        _trades(spark, sf_dir, "l_discount", "l_tax", "l_quantity", "l_linestatus")
        .groupBy("symbol", "date")
        .agg(
            F.sum(cents).alias("tick"),
            F.count(F.lit(1)).alias("n"),
            F.max(tax).alias("tmax"),
            F.min(tax).alias("tmin"),
            F.sum("l_quantity").alias("q"),
            F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)).alias("qf"),
        )
        .withColumn("lvl", F.sum("tick").over(by_symbol()))
    )
    close = _finite(F.round(F.exp(F.col("lvl") * 0.005) * 10000))
    gap = F.lit(100) + F.lit(2.5) * (F.col("n") % 5 - 2)
    open_ = _finite(F.round(F.exp((F.col("lvl") - F.col("tick")) * 0.005) * 100 * gap))
    day = day.withColumns({"close_c": close, "open_c": open_})
    high = _whole(F.greatest("open_c", "close_c") * (F.lit(1000) + F.col("tmax") * 2) / 1000)
    low = _whole(F.least("open_c", "close_c") * (F.lit(1000) - F.col("tmin") * 2) / 1000)
    return day.select(
        "symbol", "date",
        (F.col("open_c") / 100).alias("open"),
        (high / 100).alias("high"),
        (low / 100).alias("low"),
        (F.col("close_c") / 100).alias("close"),
        (F.col("q") * F.col("q") * 50).cast("long").alias("volume"),
        (F.col("qf") * 100 / F.col("q")).alias("deliv_per"),
        F.col("qf").alias("deliv_qty"),
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol -> sector; the last group carries the label that funds carry."""
    n = F.col("_n")
    return (
        table(spark, sf_dir, "part").select(_brand_number().alias("_n")).distinct()
        .select(symbol_of_brand(n).alias("symbol"),
                F.when(n % 6 == 5, "Equity").otherwise(F.concat(F.lit("SEC"), (n % 6).cast("string"))).alias("sector"))
    )


def screener_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (symbol, date, screener)."""
    pairs = []
    for code, name in SCREENER_OF_CODE.items():
        pairs += [F.lit(code), F.lit(name)]
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.try_element_at(F.create_map(*pairs), F.concat_ws("|", "o_orderpriority", "o_orderstatus")).alias("screener"))
    t = _trades(spark, sf_dir, "l_orderkey")
    return (t.join(orders, t.l_orderkey == orders.o_orderkey)
            .select("symbol", "date", "screener").distinct())


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk and block deals: symbol, date, kind, side, quantity, client."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("client"))
    t = _trades(spark, sf_dir, "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").where(
        F.col("l_returnflag").isin("R", "A"))
    return t.join(supplier, t.l_suppkey == supplier.s_suppkey).select(
        "symbol", "date",
        F.when(F.col("l_linestatus") == "F", "bulk").otherwise("block").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("quantity"), "client")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: numeric senders are the broadcast channel."""
    return messages_with_time(table(spark, sf_dir, "events")).drop("ts")


def messages_with_time(events: DataFrame) -> DataFrame:
    """Messages of an events table or stream, with their event time ``ts``."""
    v = F.round("value").cast("long")
    verb = (F.when(F.col("event_type") == "purchase", "buy")
            .when(F.col("event_type") == "error", "exit").otherwise("watch"))
    numeric = F.col("user_id") % 5 == 0
    tag = F.when(F.col("event_type") == "signup", " positional").otherwise("")
    text = F.concat(
        verb, F.lit(" "), symbol_of_brand((F.col("event_id") % 25 + 1).cast("int")),
        F.lit(" above "), v.cast("string"), F.lit(" target "), (v * 2).cast("string"),
        F.lit(" sl "), (v - 3).cast("string"), tag)
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("message_id"),
        F.date_add(F.lit("1996-01-01").cast("date"), (F.col("event_id") % 1500).cast("int")).alias("date"),
        F.when(numeric, F.col("user_id").cast("string"))
        .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("sender"),
        text.alias("text"),
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("group_id"),
    )


def listed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed symbols with a company name built from the parts they cover."""
    named = table(spark, sf_dir, "part").groupBy(_brand_number().alias("_n")).agg(F.min("p_name").alias("_p"))
    return named.select(
        symbol_of_brand(F.col("_n")).alias("symbol"),
        F.concat(F.upper(F.regexp_replace("_p", " ", "")), F.chr(F.col("_n") + 64), F.lit(" Industries Limited")).alias("company_name"))
