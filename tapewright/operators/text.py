"""Tickers, directions, price levels and mentions out of free text.

Every rule is a column expression over the whole message table; symbols are found by
splitting messages into tokens and joining those to the dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import is_true
from ..session import cut_lineage
from ..settings import DEFAULTS, MENTION_STOPWORDS, RECOMMENDATION_STOPWORDS, Thresholds

# ---------------------------------------------------------------------------
# The text patterns that decide what is read from a message.
# ---------------------------------------------------------------------------
NUMBER = r"([0-9]{2,6}(?:\.[0-9]{1,2})?)"
BUY_WORDS = r"(?i)\b(buy|accumulate|add|long|enter|entry)\b"
SELL_WORDS = r"(?i)\b(sell|exit|book|short|profit\s*book)\b"
TARGET_LEVEL = r"(?i)(?:tgt|target|t\d?)[\s:=@-]*" + NUMBER
TARGET_LEVEL_WORD = r"(?i)\b(?:tgt|target|t\d?)\b[\s:=@-]*" + NUMBER
STOP_LEVEL = r"(?i)(?:sl|stop\s*loss|stoploss)[\s:=@-]*" + NUMBER
ENTRY_LEVEL = r"(?i)(?:above|entry|cmp|@|around|near)[\s:=-]*" + NUMBER
ADMIN_SENDER = r"^-?\d+$"
CONVICTION = r"(?i)(POSITIONAL|MULTIBAGGER|LONG\s*TERM|FOCUS)"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def direction(text: Column) -> Column:
    return F.when(text.rlike(BUY_WORDS), "BUY").when(text.rlike(SELL_WORDS), "SELL").otherwise("")


def level(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")


def is_admin(sender: Column) -> Column:
    return is_true(text_or_empty(sender).rlike(ADMIN_SENDER))


def conviction_tag(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, CONVICTION, 1)), F.lit(""))


def admin_target(text: Column) -> Column:
    """struct(price, multiple) from the 130 characters at the first 'TARGET'."""
    at = F.instr(F.upper(text), "TARGET")
    tail = F.when(at > 0, F.substring(text, at, F.lit(130)))
    numbers = F.transform(
        F.regexp_extract_all(tail, F.lit(r"\b([0-9]{2,6})\b"), 1), lambda s: s.try_cast("double"))
    price = F.array_max(F.filter(numbers, lambda n: n >= 10))
    times = F.nullif(F.regexp_extract(tail, r"(?i)([2-9])\s*X\b", 1), F.lit(""))
    return F.struct(
        price.alias("price"),
        F.when(price.isNull() & times.isNotNull(), F.concat(times, F.lit("x"))).alias("multiple"))


# ---- dictionary and recommendations ------------------------------------------

def company_words(listed: DataFrame, order: str = "place") -> DataFrame:
    """(token, symbol): significant first word of a company name, first listing wins.

    ``place`` is where the listing's file has the company (``files.read_listing``); a listing
    without it has no first, there the smallest symbol wins.
    """
    first = F.regexp_replace(
        F.regexp_extract(F.upper(F.col("company_name")), r"^\s*(\S+)", 1), "[^A-Z0-9]", "")
    by = order if order in listed.columns else "symbol"
    words = listed.select(first.alias("token"), F.upper(F.trim("symbol")).alias("symbol"), F.col(by).alias("_o"))
    words = words.where((F.length("token") >= 5) & ~F.col("token").isin(*RECOMMENDATION_STOPWORDS))
    return words.groupBy("token").agg(F.min_by("symbol", F.struct("_o", "symbol")).alias("symbol"))


def ticker_dictionary(listed: DataFrame, order: str = "place") -> DataFrame:
    """token -> symbol; an exact symbol wins over a company word."""
    exact = listed.select(F.upper(F.trim("symbol")).alias("token")).distinct().withColumns(
        {"symbol": F.col("token"), "_rank": F.lit(0)})
    words = company_words(listed, order).withColumn("_rank", F.lit(1))
    return exact.unionByName(words).groupBy("token").agg(F.min_by("symbol", "_rank").alias("symbol"))


def message_tokens(text: Column, pattern: str, stopwords: list[str], *, trim: str | None = None) -> Column:
    """Upper-case tokens of one message without stop-words, in order."""
    found = F.regexp_extract_all(F.upper(text_or_empty(text)), F.lit(pattern), 0)
    if trim:
        found = F.transform(found, lambda t: F.btrim(t, F.lit(trim)))
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords))


def find_symbols(messages: DataFrame, listed: DataFrame, keys=("group_id", "message_id")) -> DataFrame:
    """(keys, symbol, first_at): symbols of each message with the place first seen."""
    tokens = messages.select(
        *keys, F.posexplode(message_tokens(F.col("text"), "[A-Za-z&]{3,}", RECOMMENDATION_STOPWORDS, trim="&"))
        .alias("_at", "token"))
    return tokens.join(ticker_dictionary(listed), "token").groupBy(*keys, "symbol").agg(
        F.min("_at").alias("first_at"))


def recommendations(messages: DataFrame, listed: DataFrame, *, word_boundary: bool = False) -> DataFrame:
    """One row per message and symbol with direction and levels.

    A message is read once: its parsed columns stay beside its distinct tokens, so only rows
    whose token names a symbol are shuffled.  Repeated identical messages give one row.
    """
    text = text_or_empty(F.col("text"))
    tokens = F.array_distinct(message_tokens(F.col("text"), "[A-Za-z&]{3,}", RECOMMENDATION_STOPWORDS, trim="&"))
    parsed = messages.select(
        "date", F.col("sender").alias("caller"),
        direction(text).alias("direction"),
        level(text, ENTRY_LEVEL).alias("entry"),
        level(text, TARGET_LEVEL_WORD if word_boundary else TARGET_LEVEL).alias("target"),
        level(text, STOP_LEVEL).alias("sl"),
        "message_id", "group_id",
        F.substring(text, 1, 200).alias("raw_text"),
        tokens.alias("_tokens"),
    )
    said = parsed.where(F.size("_tokens") > 0).withColumn("token", F.explode("_tokens")).drop("_tokens")
    return said.join(ticker_dictionary(listed), "token").select(
        "date", "caller", "symbol", "direction", "entry", "target", "sl", "message_id", "group_id", "raw_text").distinct()


# ---- mentions of given symbols -----------------------------------------------

def symbol_mentions(messages: DataFrame, symbols: DataFrame) -> DataFrame:
    """(message columns, symbol): exact, case-sensitive symbol between non-alphanumerics.

    Joined on the symbol's first alphanumeric run; symbols holding other characters are
    then verified in the text.  The symbols are stored first, so that Spark knows their size: a run that every
    message has would bring all messages into one task, which a broadcast of the symbols avoids.
    """
    runs = F.array_distinct(F.regexp_extract_all(text_or_empty(F.col("text")), F.lit("[A-Z0-9]+"), 0))
    exploded = messages.withColumn("_run", F.explode(runs))
    named = symbols.select("symbol").distinct().withColumn(
        "_run", F.regexp_extract("symbol", "[A-Z0-9]+", 0)).where(F.col("_run") != "")
    named = cut_lineage(named, "symbols")
    exact = F.concat(F.lit(r"(?<![A-Z0-9])\Q"), F.col("symbol"), F.lit(r"\E(?![A-Z0-9])"))
    whole = (F.col("symbol") == F.col("_run")) | F.rlike(F.col("text"), exact)
    return exploded.join(named, "_run").where(whole).drop("_run")


def recent_messages(messages: DataFrame, sheet_date, days: int) -> DataFrame:
    day = F.lit(sheet_date).cast("date")
    return messages.where(F.col("date").between(F.date_sub(day, days), day))


def mention_stats(mentions: DataFrame, sheet_date) -> DataFrame:
    """Per symbol: mentions, those by the broadcast channel, last date and its age."""
    return mentions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if(is_admin(F.col("sender"))).alias("admin_mentions"),
        F.max("date").alias("last_date"),
    ).withColumn("days_since", F.datediff(F.lit(sheet_date).cast("date"), F.col("last_date")))


def admin_calls(messages: DataFrame, symbols: DataFrame, sheet_date) -> DataFrame:
    """Newest broadcast message per symbol that carries a target or a conviction tag.

    With a time ``ts`` the earlier of two simultaneous messages counts; with dates alone
    the later message of the day does.
    """
    day = F.lit(sheet_date).cast("date")
    text = text_or_empty(F.col("text"))
    calls = messages.where(
        is_admin(F.col("sender")) & (F.col("date") <= day)
        & (F.upper(text).contains("TARGET") | text.rlike(CONVICTION)))
    picked = F.max_by(
        F.struct("date", admin_target(text).alias("target"), conviction_tag(text).alias("tag")),
        F.struct("ts", -F.col("message_id")) if "ts" in messages.columns else F.struct("date", "message_id"))
    return symbol_mentions(calls, symbols).groupBy("symbol").agg(picked.alias("c")).select(
        "symbol", F.col("c.date").alias("call_date"), F.col("c.target.price").alias("target"),
        F.col("c.target.multiple").alias("target_multiple"), F.col("c.tag").alias("tag"),
        F.datediff(day, F.col("c.date")).alias("call_days"))


def group_mentions(messages: DataFrame, symbols: DataFrame, sheet_date, *, t: Thresholds = DEFAULTS) -> DataFrame:
    """Recent buzz per symbol with the newest call; only symbols with recent mentions."""
    recent = symbol_mentions(recent_messages(messages, sheet_date, t.mention_window_days), symbols)
    stats = mention_stats(recent, sheet_date)
    return stats.join(admin_calls(messages, symbols, sheet_date), "symbol", "left")


def precedence_mentions(messages: DataFrame, listed: DataFrame, keys=("group_id", "message_id")) -> DataFrame:
    """Up to three listed symbols per message, alphabetical, for outcome tests."""
    tokens = messages.select(
        *keys, "date", is_admin(F.col("sender")).alias("admin"),
        F.explode(F.array_distinct(message_tokens(F.col("text"), "[A-Z&]{3,}", MENTION_STOPWORDS))).alias("symbol"))
    known = listed.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    hits = tokens.join(known, "symbol", "left_semi")
    # One message holds a bounded number of tokens, so this set is small.
    per_message = hits.groupBy(*keys, "date", "admin").agg(
        F.slice(F.sort_array(F.collect_set("symbol")), 1, 3).alias("_s"))
    return per_message.select(*keys, "date", "admin", F.explode("_s").alias("symbol"))
