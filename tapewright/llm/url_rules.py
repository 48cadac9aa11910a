"""URL filters: host-suffix and path-prefix expressions, joined to a rule table by short hash prefixes.

Each URL is expanded into the expressions a rule could have, each expression is digested, the first 32 bits of the
digest are the join key, and a match counts only when the whole digest is equal. Built-in functions only. The rule
side is grouped by nothing and broadcast only when Spark's own size check allows it; otherwise the join is a
shuffled one, where a common expression (``com/``) is split by adaptive skew handling. Matches, which are few, are
reduced to the best rule per page before they meet the pages again.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule. Rows with the same
page and URL get the same verdict and all stay. An empty rule table gives the default verdict everywhere. A null or
empty rule host fits nothing, a null rule path is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import ascii_lower

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Verdict where no rule fits.
DEFAULT = "allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def path_prefixes(path: Column, lengths: list[int]) -> Column:
    """The prefixes of the path that have a length some rule's path has."""
    return F.filter(
        F.transform(F.array(*(F.lit(n) for n in lengths)), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))),
        lambda x: x.isNotNull(),
    )


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_name: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, the longest rule that fits (null: none) and the verdict.

    Equally long rules: block before allow, then the greater text.
    """
    table = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(ascii_lower(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
        .select(F.concat("h", "p").alias("rule"), F.length("p").alias("n"), "verdict")
    )
    # A path has no more lengths than the longest rule has characters, so this list is bounded by that length.
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())
    judged = pages.select(F.col(id_name).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    if not lengths:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = table.select(
        "rule", "verdict", _digest(F.col("rule")).alias("rule_digest"), F.substring(_digest(F.col("rule")), 1, 8).alias("prefix")
    )
    expressions = F.flatten(
        F.transform(host_suffixes(F.col("host")), lambda h: F.transform(path_prefixes(F.col("path"), lengths), lambda p: F.concat(h, p)))
    )
    best = (
        judged.where("host != ''")
        .select("page_id", "url", F.explode(F.array_distinct(expressions)).alias("e"))
        .select("page_id", "url", _digest(F.col("e")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, 8))
        .join(keyed, "prefix")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("page_id", "url")
        .agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("best"))
        .select(F.col("page_id").alias("k"), F.col("url").alias("u"), "best")
    )
    return judged.join(best, F.col("page_id").eqNullSafe(F.col("k")) & (F.col("url") == F.col("u")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
