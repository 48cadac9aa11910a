"""Registered queries of this subpackage and the SQL they must equal where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.session import shared_folder

from . import (
    bpe_automaton,
    contextual_pii,
    decontaminate,
    jaccard,
    language,
    merkle_manifest,
    periodic_runs,
    pitman_yor,
    quality,
    suffix_array,
    superkmers,
    token_counts,
    url_rules,
)
from .columns import id_checksum, id_remainder

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query
def op1_language_id(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = language.train(docs.where(id_remainder("doc_id", 5) != 0).select("text", "lang"))
    found = language.identify(docs, model)
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@_query
def op2_pitman_yor_lm(spark, sf_dir):
    return pitman_yor.score_documents(_documents(spark, sf_dir), id_remainder("doc_id", 5) == 1)


@_query
def op3_substring_dedup(spark, sf_dir):
    found = superkmers.dedup_words(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op4_bpe_automaton(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe_automaton.code_documents(_documents(spark, sf_dir), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op8_benchmark_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@functools.lru_cache(maxsize=64)
def _token_cache(spark, shared, version):
    """One cache folder per session, shared folder and tokenizer version."""
    return shared_folder(spark, "token-counts")


@_query
def op9_token_counts(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    cache = _token_cache(spark, spark.conf.get("spark.checkpoint.dir", None), token_counts.tokenizer_version(path))
    return token_counts.count_tokens(_documents(spark, sf_dir), path, cache)


@_query
def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard.component_ids(_documents(spark, sf_dir))


@_query
def op6_url_filters(spark, sf_dir):
    return url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rule_table(spark))


ORACLES["op6_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT n, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
"""


@_query
def op7_quality_rules(spark, sf_dir):
    return quality.judge_quality(_documents(spark, sf_dir))


ORACLES["op7_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (
  SELECT n, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, len(words) - 3)) AS r(i) WHERE len(words) >= 5),
rep AS (SELECT n, i FROM win QUALIFY count(*) OVER (PARTITION BY n, g) > 1),
cov AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS o(k) GROUP BY n),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
             IN ({', '.join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))}))) AS n_stop_words
  FROM w LEFT JOIN cov USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT coalesce(n_symbols / n_words > 0.5, false)
       AND NOT coalesce(word_chars / n_words < 2.0 OR word_chars / n_words > 15.0, false)
       AND NOT coalesce(n_dup_lines / n_lines > 0.5, false)
       AND NOT coalesce(n_words / n_lines < 1.0, false)
       AND NOT coalesce(n_words >= 60 AND n_stop_words / n_words < 0.01, false) AS kept
FROM b
"""


@_query
def op10_suffix_array_dedup(spark, sf_dir):
    found = suffix_array.dedup_bytes(_documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query
def op11_periodic_runs(spark, sf_dir):
    found = periodic_runs.collapse_runs(_documents(spark, sf_dir), rewrite=id_checksum("doc_id"))
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The checksum of a decimal id, with the table of its 256 byte steps.
_CHECKSUM = """
steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
sums AS (
  SELECT doc_id, CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) END AS h
  FROM (SELECT DISTINCT doc_id FROM documents), steps)"""

ORACLES["op11_periodic_runs"] = rf"""
WITH {_CHECKSUM},
given AS (
  SELECT row_number() OVER () AS n, d.doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words
  FROM documents d JOIN sums s ON d.doc_id IS NOT DISTINCT FROM s.doc_id),
d AS (SELECT *, len(words) AS size, CASE WHEN len(words) > 0 AND h % 10 = 0 THEN g % len(words) END AS a FROM given),
pos AS (
  SELECT n, size, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (size - a) // (3 + g % 8)) ELSE i END] AS w
  FROM d, unnest(range(size)) AS r(i)),
alike AS (
  SELECT x.n, x.i, y.i - x.i AS q
  FROM pos x JOIN pos y ON x.n = y.n AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.size),
stretch AS (SELECT *, i - row_number() OVER (PARTITION BY n, q ORDER BY i) AS part FROM alike),
periodic AS (
  SELECT n, q, min(i) AS s, max(i) + q + 1 AS e FROM stretch GROUP BY n, q, part
  HAVING max(i) + q + 1 - min(i) >= greatest(6, 4 * q)),
runs AS (SELECT n, s, e, min(q) AS q FROM periodic GROUP BY n, s, e),
summary AS (
  SELECT n, count(*) AS n_runs, arg_min([s, e - s, q], [s - e, s, q]) AS top,
         string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY n),
gone AS (SELECT DISTINCT n, i FROM runs, unnest(range(s + q, e)) AS r(i)),
kept AS (SELECT n, string_agg(w, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (n, i) GROUP BY n)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[1] AS start, top[2] AS length, top[3] AS period,
       1000 * top[2] // top[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN summary USING (n) LEFT JOIN kept USING (n)
"""


@_query
def op12_contextual_pii(spark, sf_dir):
    found = contextual_pii.find_identifiers(_documents(spark, sf_dir))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(contextual_pii.KINDS)),
        F.sha2(contextual_pii.span_list(F.col("base")), 256).alias("base_sha256"),
        contextual_pii.span_list(F.concat("base", "added")).alias("spans"),
    )


@_query
def op13_merkle_manifest(spark, sf_dir):
    found = merkle_manifest.prove_rows(
        _documents(spark, sf_dir),
        ["doc_id", "source", "lang", "n_chars", "text"],
        claimed={"n_chars": F.col("n_chars") + 1},
        when=id_checksum("doc_id") % 7 == 0,
    )
    proof = F.sha2(F.concat_ws("", "siblings"), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def _framed(*names: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in names)


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels over ``leaves`` (g, r, n, digest), and the pairs of siblings (left|right) from each leaf up, as a list."""
    return f"""
{name} AS (
  SELECT g, 0 AS level, r AS idx, n, digest FROM {leaves}
  UNION ALL
  SELECT g, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY g, level, idx // 2),
{name}_top AS (SELECT g, digest FROM {name} WHERE n = 1),
{name}_path AS (
  SELECT l.g, l.r, list(CASE WHEN t.idx & 1 = 1 THEN s.digest || '|' ELSE '|' || coalesce(s.digest, '') END ORDER BY t.level) AS path
  FROM {leaves} l JOIN {name} t ON t.g = l.g AND t.idx = l.r >> t.level AND t.n > 1
  LEFT JOIN {name} s ON s.g = t.g AND s.level = t.level AND s.idx = xor(t.idx, 1)
  GROUP BY l.g, l.r)"""


ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CHECKSUM},
rows AS (
  SELECT d.*, h % 7 = 0 AS changed, coalesce('=' || lang, '') AS g, sha256({_framed("d.doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         sha256({_framed("d.doc_id", "source", "lang", "(n_chars + 1)", "text")}) AS other
  FROM documents d JOIN sums s ON d.doc_id IS NOT DISTINCT FROM s.doc_id),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n, leaf AS digest
  FROM rows),
{_tree("low", "leaves")},
subs AS (SELECT '' AS g, g AS of, digest, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM low_top),
{_tree("high", "subs")},
proofs AS (
  SELECT l.doc_id, l.leaf, s.digest AS subroot, (SELECT digest FROM high_top) AS root, CASE WHEN changed THEN other ELSE leaf END AS start,
         list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path
  FROM leaves l JOIN subs s ON s.of = l.g
  LEFT JOIN low_path p ON p.g = l.g AND p.r = l.r LEFT JOIN high_path q ON q.r = s.r),
done AS (
  SELECT *, list_reduce(list_prepend(start, path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM done
"""
