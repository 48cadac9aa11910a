"""Column expressions over screener names and comma lists of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    BASE_KEYWORDS,
    BREAKOUT_KEYWORDS,
    DEFAULTS,
    MOMENTUM_KEYWORDS,
    SCREENER_WEIGHTS,
    UNSEEN_SCREENER_WEIGHT,
    Thresholds,
)


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_screener(name: Column) -> Column:
    """Drop a trailing 6-8 digit date stamp, use ``_`` as the only separator, upper-case."""
    no_stamp = F.regexp_replace(strip_ws(name), r"[_\-\s]*\d{6,8}$", "")
    unified = F.regexp_replace(strip_ws(no_stamp), r"[\s\-]+", "_")
    return F.btrim(F.upper(unified), F.lit("_"))


def categorize_screener(normalized: Column) -> Column:
    """'base', 'breakout' or 'momentum'; the base keywords win, unknown names are base."""
    return (
        F.when(normalized.rlike("|".join(BASE_KEYWORDS)), "base")
        .when(normalized.rlike("|".join(BREAKOUT_KEYWORDS)), "breakout")
        .when(normalized.rlike("|".join(MOMENTUM_KEYWORDS)), "momentum")
        .otherwise("base")
    )


def split_list(value: Column) -> Column:
    """Comma text to an array without blanks; NULL or blank text gives an empty array."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip_ws)
    return F.filter(parts, lambda s: s != "")


def tag_screeners(screeners: Column) -> Column:
    """array(struct(name, norm, cat)): each name is normalized and categorized once."""
    named = F.transform(screeners, lambda s: F.struct(s.alias("name"), normalize_screener(s).alias("norm")))
    return F.transform(named, lambda t: F.struct(
        t["name"].alias("name"), t["norm"].alias("norm"), categorize_screener(t["norm"]).alias("cat")))


def names_in(tags: Column, *categories: str) -> Column:
    return F.transform(F.filter(tags, lambda t: t["cat"].isin(*categories)), lambda t: t["name"])


def in_category(screeners: Column, category: str) -> Column:
    return names_in(tag_screeners(screeners), category)


def weight_map(weights: dict[str, int] | None = None) -> Column:
    """A literal map for the handful of configured screener weights."""
    pairs = []
    for name, points in (weights or SCREENER_WEIGHTS).items():
        pairs += [F.lit(name), F.lit(int(points))]
    return F.create_map(*pairs)


def pattern_score(screeners: Column, weights: Column | None = None, t: Thresholds = DEFAULTS) -> Column:
    """Capped sum of weights over the distinct normalized names."""
    return points_of(F.transform(screeners, normalize_screener), weights, t)


def points_of(normalized: Column, weights: Column | None = None, t: Thresholds = DEFAULTS) -> Column:
    table = weight_map() if weights is None else weights
    points = F.transform(
        F.array_distinct(normalized),
        lambda n: F.coalesce(F.try_element_at(table, n), F.lit(UNSEEN_SCREENER_WEIGHT)),
    )
    return F.least(F.aggregate(points, F.lit(0), lambda acc, p: acc + p), F.lit(t.pattern_cap))


def screener_count(screeners: Column) -> Column:
    return F.coalesce(F.size(screeners), F.lit(0))


def new_screeners(today: Column, previous: Column) -> Column:
    """Sorted names present today but not before; with no previous row all of today's."""
    return F.when(previous.isNull(), today).otherwise(
        F.array_sort(F.array_except(today, previous))
    )


def screener_name_from_stem(stem: Column) -> Column:
    """File stem without its ``_YYYYMMDD_HHMMSS`` suffix, else without its last ``_`` part."""
    stamped = F.regexp_extract(stem, r"^(.*)_\d{8}_\d{6}$", 1)
    return F.when(stem.rlike(r"^.*_\d{8}_\d{6}$"), stamped).otherwise(
        F.regexp_replace(stem, r"_[^_]*$", "")
    )
