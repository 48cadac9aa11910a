"""CSV file sets read by column name, with dates and names taken from the file path."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.screeners import screener_name_from_stem, strip_ws
from ..settings import COLUMN_ALIASES, EQUITY_SERIES
from .manifest import BROADCAST_FILES, first_lines, list_files, one_per_date, plain_path, unit_of


def missing() -> Column:
    return F.lit(None).cast("string")


def to_number(c: Column) -> Column:
    """Text to double without thousands commas; anything unreadable, NaN included, is NULL."""
    v = strip_ws(F.regexp_replace(c.cast("string"), ",", "")).try_cast("double")
    return F.nanvl(v, F.lit(None).cast("double"))


def percent_to_number(c: Column) -> Column:
    return to_number(F.regexp_replace(c.cast("string"), "%", ""))


def parse_date(c: Column) -> Column:
    """``YYYY-MM-DD`` or ``DDMMYYYY`` text; anything else is NULL."""
    s = strip_ws(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")).when(
        s.rlike(r"^\d{8}$"), F.try_to_date(s, "ddMMyyyy"))


def parse_vendor_date(c: Column) -> Column:
    """``dd-Mon-yyyy`` text; anything else is NULL."""
    return F.try_to_date(strip_ws(c), "dd-MMM-yyyy")


def date_in_path(path: Column) -> Column:
    """Date stamped at the end of a file (or folder) name as ``_DDMMYYYY`` or ``_YYYY-MM-DD``."""
    compact = F.regexp_extract(path, r"_(\d{8})(?:\.csv)?(?:/[^/]*)?$", 1)
    iso = F.regexp_extract(path, r"_(\d{4}-\d{2}-\d{2})(?:[^/_]*\.csv)?(?:/[^/]*)?$", 1)
    return F.coalesce(parse_date(F.nullif(compact, F.lit(""))), parse_date(F.nullif(iso, F.lit(""))))


def has_canonical_name(path: Column) -> Column:
    return path.rlike(r"_\d{8}(?:\.csv)?(?:/[^/]*)?$")


def read_csv_by_name(spark: SparkSession, paths: str | Sequence[str], *, aliases: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """Read CSV files whose headers differ, matching columns by trimmed name.

    Only the first lines are looked at beforehand, on the executors; then all files are one scan, in which each line
    meets the header of its file.  A column missing from a file is NULL, and a line equal to its file's header is none
    of its rows.  All values are text; ``_path`` (the file, or the folder Spark wrote under a file's name) and ``_seq``
    (place in the file) are kept.  What comes to the driver are the distinct column names.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    listed = manifest if manifest is not None else list_files(spark, paths)
    cell = lambda h: F.trim(F.regexp_replace(strip_ws(h), '^"|"$', ""))
    headers = first_lines(listed).select(
        "path", "header", F.transform(F.split(F.regexp_replace("header", "^\\x{FEFF}", ""), ","), lambda h: cell(h)).alias("names"))
    found = headers.agg(
        F.count(F.lit(1)).alias("files"), F.max(F.size("names")).alias("width"), F.array_sort(F.collect_set("names")).alias("variants")).first()
    if not found.files:
        raise FileNotFoundError(f"no files under {paths}")
    places: dict[str, list[tuple[list[str], int]]] = {}
    for variant in found.variants:
        renamed = canonical_names(variant) if aliases else variant
        for i, name in enumerate(renamed):
            places.setdefault(name or f"_c{i}", []).append((variant, i))
    lines = spark.read.text(paths, recursiveFileLookup=True).select(
        "value", plain_path().alias("path"), F.struct(
            F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_seq")).where("value != ''")
    known = F.broadcast(headers) if found.files <= BROADCAST_FILES else headers
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(found.width)))
    rows = lines.join(known, "path").where(F.col("value") != F.col("header")).withColumn("_cells", cells)

    def value(of: list[tuple[list[str], int]]) -> Column:
        by_place: dict[int, list[list[str]]] = {}
        for variant, i in of:
            by_place.setdefault(i, []).append(variant)
        at = [F.when(F.col("names").isin(*[F.array(*map(F.lit, v)) for v in variants]), F.col(f"_cells.c{i}")) for i, variants in by_place.items()]
        return F.coalesce(*at) if len(found.variants) > 1 else F.col(f"_cells.c{of[0][1]}")

    return rows.select(*(value(of).alias(name) for name, of in places.items()), unit_of(F.col("path")).alias("_path"), "_seq")


def canonical_names(names: Sequence[str]) -> list[str]:
    """Rename known header variants (case-insensitive) to the five common columns."""
    out = list(names)
    for standard, known in COLUMN_ALIASES.items():
        if standard in out:
            continue
        lowered = {n.lower(): i for i, n in enumerate(out)}
        hit = next((out.index(a) if a in out else lowered[a.lower()]
                    for a in known if a in out or a.lower() in lowered), None)
        if hit is not None:
            out[hit] = standard
    return out


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else missing()


def prefer_source(df: DataFrame, priority: str = "_priority", date: str = "date") -> DataFrame:
    """Keep each date only from its best-ranked source.

    The per-date choice has one row per calendar date.
    """
    best = df.groupBy(date).agg(F.min(priority).alias("_best"))
    return (df.join(best, date)
            .where(F.col(priority) == F.col("_best")).drop("_best", priority))


# ---- bars ------------------------------------------------------------------

def read_dated(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """Rows of dated files, one file per date, with ``date``: of the first directory, then by the compact form of the
    name, then by name.  The files of a date that lose are never opened."""
    unit = F.col("unit")
    listed = list_files(spark, directories)
    chosen = one_per_date(listed, date_in_path(unit), F.when(has_canonical_name(unit), 0).otherwise(1))
    # one row per calendar date
    units = [r.unit for r in chosen.select("unit").collect()]
    if not units:
        raise FileNotFoundError(f"no dated files under {list(directories)}")
    kept = listed.join(F.broadcast(chosen.select("unit", "priority")), ["unit", "priority"], "left_semi")
    raw = read_csv_by_name(spark, units, manifest=kept)
    return raw.withColumn("date", date_in_path(F.col("_path")))


def read_bar_files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """Raw bar rows of dated files; for a date found in several directories the first wins."""
    return normalize_bar_headers(read_dated(spark, directories))


def normalize_bar_headers(raw: DataFrame) -> DataFrame:
    """SYMBOL and DATE1 get their usual names and the key text columns are trimmed."""
    df = raw.withColumnsRenamed({"SYMBOL": "Symbol", "DATE1": "Date"}) if "Symbol" not in raw.columns \
        else raw.withColumnsRenamed({"DATE1": "Date"})
    text = [c for c in ("Date", "Symbol", "SERIES", "DELIV_PER") if c in df.columns]
    return df.withColumns({c: strip_ws(F.col(c)) for c in text})


def conform_bars(raw: DataFrame) -> DataFrame:
    """Typed bars of the equity series from raw text rows that carry ``date``."""
    number = {
        "open": "OPEN_PRICE", "high": "HIGH_PRICE", "low": "LOW_PRICE", "close": "CLOSE_PRICE",
        "volume": "TTL_TRD_QNTY", "deliv_per": "DELIV_PER", "deliv_qty": "DELIV_QTY",
    }
    series = strip_ws(column_or_null(raw, "SERIES"))
    extra = ["_seq"] if "_seq" in raw.columns else []
    return raw.where(series.isin(*EQUITY_SERIES)).select(
        strip_ws(F.col("Symbol")).alias("symbol"), "date", series.alias("series"),
        *[to_number(column_or_null(raw, src)).alias(dst) for dst, src in number.items()], *extra)


def build_panel(bars: DataFrame, *, order: str | None = None) -> DataFrame:
    """Unique (symbol, date) bars with a positive close; the last one in ``order`` wins.

    An aggregate with map-side combine, so duplicates never gather in one task.
    """
    rows = bars.where(F.col("symbol").isNotNull() & F.col("date").isNotNull() & (F.col("close") > 0))
    order = order or ("_seq" if "_seq" in bars.columns else None)
    others = [c for c in bars.columns if c not in ("symbol", "date", order)]
    last_by = F.col(order) if order else F.struct(*[F.col(c) for c in others])
    kept = rows.groupBy("symbol", "date").agg(F.max_by(F.struct(*others), last_by).alias("r"))
    return kept.select("symbol", "date", "r.*")


def latest_series(bars: DataFrame) -> DataFrame:
    """Symbol -> settlement series on the newest date."""
    newest = bars.agg(F.max("date").alias("d"))
    return bars.where(F.col("date") == newest.scalar()).groupBy("symbol").agg(F.max("series").alias("series"))


# ---- sheets ----------------------------------------------------------------

SHEET_TEXT = ["Symbol", "Stock Name", "Sector", "Screener_today", "Screener_yesterday",
              "new_screeners_today", "was_in_previous_sheet"]
SHEET_NUMBERS = ["Price", "Volume", "Today_screener_count", "screener_count_diff", "DELIV_PER",
                 "BUY_quantity", "SELL_quantity"]


def conform_sheet(raw: DataFrame) -> DataFrame:
    """Sheet rows with every expected column: missing ones NULL, suffixed quantities merged."""
    def quantity(side: str) -> Column:
        # A file has either the plain column or the suffixed pair; a history may mix both.
        return F.coalesce(*[column_or_null(raw, f"{side}{suffix}") for suffix in ("", "_x", "_y")])

    source = {c: column_or_null(raw, c) for c in SHEET_TEXT + SHEET_NUMBERS}
    source["BUY_quantity"], source["SELL_quantity"] = quantity("BUY_quantity"), quantity("SELL_quantity")
    return raw.select(
        "date",
        *[F.nullif(strip_ws(source[c].cast("string")), F.lit("")).alias(c) for c in SHEET_TEXT],
        *[to_number(source[c]).alias(c) for c in SHEET_NUMBERS],
        percent_to_number(column_or_null(raw, "% Chg")).alias("chg"),
        *(["_path"] if "_path" in raw.columns else []),
    )


def read_sheet_files(spark: SparkSession, directories: Sequence[str]) -> DataFrame:
    """Sheet history: earlier directories win, and within one the compact file name."""
    return sheet_panel(conform_sheet(read_dated(spark, directories)))


def sheet_panel(sheets: DataFrame) -> DataFrame:
    return sheets.dropna(subset=["Symbol", "date", "Price"])


# ---- screener files, delivery, deals -----------------------------------------

def read_screener_files(spark: SparkSession, path: str) -> DataFrame:
    """Hits of per-screener files: screener from the file stem, common column names."""
    return conform_hits(read_csv_by_name(spark, path, aliases=True))


def conform_hits(raw: DataFrame, *extra: str) -> DataFrame:
    """Typed hits; columns named in ``extra`` are kept as they are."""
    stem = F.regexp_extract(F.col("_path"), r"([^/=]+?)(?:\.csv)?$", 1)
    screener = column_or_null(raw, "Screener") if "Screener" in raw.columns else screener_name_from_stem(stem)
    return raw.select(
        strip_ws(F.col("Symbol")).alias("symbol"),
        screener.alias("screener"),
        column_or_null(raw, "Stock Name").alias("stock_name"),
        percent_to_number(column_or_null(raw, "% Chg")).alias("chg"),
        to_number(column_or_null(raw, "Price")).alias("price"),
        to_number(column_or_null(raw, "Volume")).alias("volume"),
        "_path", *extra)


def with_folder_date(hits: DataFrame) -> DataFrame:
    """Date of the folder that holds the file, ``.../YYYY-MM-DD/file``."""
    folder = F.regexp_extract("_path", r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return hits.withColumn("date", parse_date(F.nullif(folder, F.lit("")))).drop("_path")


def conform_delivery(raw: DataFrame) -> DataFrame:
    return raw.select(
        strip_ws(F.col("Symbol")).alias("symbol"),
        parse_vendor_date(F.col("Date")).alias("date"),
        strip_ws(column_or_null(raw, "SERIES")).alias("series"),
        *[to_number(F.nullif(strip_ws(column_or_null(raw, s).cast("string")), F.lit("-"))).alias(s.lower())
          for s in ("DELIV_QTY", "DELIV_PER", "TTL_TRD_QNTY")])


def conform_deals(raw: DataFrame, kind: str | None = None) -> DataFrame:
    """Typed deals without the placeholder rows of an empty day."""
    text = F.upper(strip_ws(F.col("Date").cast("string")))
    rows = raw.where(text.isNotNull() & ~text.isin("NO RECORDS", "NAN", ""))
    client = next((c for c in raw.columns if "client" in c.lower()), None)
    return rows.select(
        strip_ws(F.col("Symbol")).alias("symbol"),
        parse_vendor_date(F.col("Date")).alias("date"),
        (F.lit(kind) if kind else column_or_null(raw, "kind")).alias("kind"),
        F.upper(strip_ws(F.col("`Buy/Sell`"))).alias("side"),
        to_number(F.col("`Quantity Traded`")).alias("quantity"),
        (strip_ws(F.col(f"`{client}`")) if client else missing()).alias("client"),
    ).where(F.col("date").isNotNull())


# ---- picks of one date ---------------------------------------------------------

def on_date(df: DataFrame, day) -> DataFrame:
    """Rows of one date; on a table stored by date only that partition is read."""
    return df.where(F.col("date") == F.lit(day).cast("date"))


def latest_rows(df: DataFrame, before=None) -> DataFrame:
    """Rows of the newest date, or of the newest date before ``before``."""
    dates = df if before is None else df.where(F.col("date") < F.lit(before).cast("date"))
    return df.where(F.col("date") == dates.agg(F.max("date")).scalar())
