"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Built-in functions only. The ratios of a text come from its words, its lines and a few character classes; each rule
of the table is one comparison on one ratio, and the verdict is their conjunction. Nothing is shuffled: the work of
a row depends on that row alone, so a hot source or a group of copies costs what its rows cost.

Defined cases: a null text is an empty one; it has no words, so it fails the base rule. Repeated rows are judged
each for itself; an empty table gives an empty result. Input columns other than the id and the text are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import ascii_lower, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
#: Words per window of the repetition count.
WINDOW = 5
#: Frequent words of the four languages of the texts.
STOP_WORDS = (
    "the of and to in a is that it was for on are with as at be by this had not but from or have an they which "
    "le la les de des du un une et en que qui dans pour par sur au est ne pas plus ce se "
    "der die das und in den von zu mit sich auf ist im dem nicht ein eine als auch es an "
    "el los las y que del se por con para una su al lo como"
).split()


class Rule(NamedTuple):
    """``ratio`` must lie within the bounds; an open bound is None. Texts under ``min_words`` words are not judged."""

    ratio: str
    low: float | None
    high: float | None
    min_words: int = 0


#: Production thresholds: they let clean prose pass at any length and catch symbol noise, tables and line spam.
RULES = (
    Rule("symbols_per_word", None, 0.5),
    Rule("chars_per_word", 2.0, 15.0),
    Rule("dup_line_share", None, 0.5),
    Rule("words_per_line", 1.0, None),
    Rule("stop_word_share", 0.01, None, 60),
)


def _repeated_words(windows: Column, words: Column) -> Column:
    """Number of words inside windows that occur at least twice, from (window, position) in window order."""
    hits = F.filter(
        windows,
        lambda x, k: (F.get(windows, k - 1)["w"] == x["w"]) | (F.get(windows, k + 1)["w"] == x["w"]),
    )
    places = F.sort_array(F.transform(hits, lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        places,
        start,
        lambda acc, p: F.struct(
            (p + WINDOW).cast("long").alias("end"),
            (acc["n"] + F.least(F.lit(WINDOW), p + WINDOW - acc["end"])).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )


def _computed(*fields: Column) -> Column:
    """A struct that is computed once: a filter on it is not pushed below, where it would repeat the work per element."""
    return F.explode(F.array(F.struct(*fields)))


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``m`` of counts.

    Windows are first compared by a 64-bit hash: when all hashes differ the windows differ and there is nothing to
    do. Only texts with equal hashes have their windows spelled out, sorted and compared.
    """
    window = lambda words, i: [F.get(words, i + k) for k in range(WINDOW)]
    places = lambda words: F.sequence(F.lit(0), F.size(words) - WINDOW)
    long_enough = F.size("words") >= WINDOW
    none = F.array().cast("array<struct<w:string,p:int>>")
    return (
        docs.withColumn("t", text_or_empty(text))
        .withColumn("words", words_of(F.col("t")))
        .withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("hashes", F.when(long_enough, F.transform(places(F.col("words")), lambda i: F.xxhash64(*window(F.col("words"), i)))))
        .withColumn(
            "windows",
            F.when(
                long_enough & (F.size(F.array_distinct("hashes")) < F.size("hashes")),
                F.sort_array(F.transform(places(F.col("words")), lambda i: F.struct(F.concat_ws(" ", *window(F.col("words"), i)).alias("w"), i.alias("p")))),
            ).otherwise(none),
        )
        .withColumn(
            "m",
            _computed(
                F.size("words").cast("long").alias("n_words"),
                F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                F.size("lines").cast("long").alias("n_lines"),
                (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                _repeated_words(F.col("windows"), F.col("words")).alias("n_repeat_words"),
                F.size(F.filter("words", lambda w: ascii_lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        )
        .drop("t", "words", "lines", "hashes", "windows")
    )


def ratios(m: Column) -> dict[str, Column]:
    """The ratios that rules may name; a ratio without a denominator is null and passes."""
    part = lambda a, b: F.when(m[b] > 0, m[a] / m[b])
    return {
        "symbols_per_word": part("n_symbols", "n_words"),
        "chars_per_word": part("word_chars", "n_words"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "words_per_line": part("n_words", "n_lines"),
        "stop_word_share": part("n_stop_words", "n_words"),
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    named = ratios(m)
    checks = []
    for rule in rules:
        value, bad = named[rule.ratio], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        checks.append(~F.coalesce(bad & (m["n_words"] >= rule.min_words), F.lit(False)))
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its counts, whether the base rule fails, and whether it is kept."""
    base = docs.select(F.col(id_name).alias("doc_id"), F.col(text).alias("text"))
    m = F.col("m")
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    return text_measures(base).select(
        "doc_id",
        *(m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        failed.alias("base_failed"),
        (~failed & verdict(m, rules)).alias("kept"),
    )
