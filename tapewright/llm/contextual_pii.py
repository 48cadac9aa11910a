"""Personal data by bootstrapped contextual extraction.

Fixed expressions find seeds: mail addresses, IP addresses, card and phone numbers. The words around seeds induce
lexical patterns, and patterns and the identifiers that they surround form a graph:

* an instance is a seed, or any other identifier-like string (letters, digits and ``@._%+-``, at least ``SHORTEST``
  characters, with a digit or an at sign) that touches no seed; equal strings are one instance;
* a pattern is two words before, two words after, or a word on each side, with the coarse shape of what it surrounds;
  patterns of fewer than ``SUPPORT`` different instances are left out.

Seeds score 1 for their kind. In every round a pattern scores, per kind, the sum of its instances over their number
plus ``DOUBT``; an instance that is no seed then scores the mean of its patterns. So patterns of the first round
discover identifiers, and these lend their weight to patterns that have few seeds. After ``ROUNDS`` an occurrence
counts as a kind where one of its patterns scores at least ``SURE_PATTERN`` and its instance ``SURE_INSTANCE``; the
best pattern decides, then the order of kinds. Scores are whole millionths, so sums don't depend on the partitioning.

Texts are read once: each row becomes its seeds and candidates with 16-byte digests of instances and patterns, which
are stored. The graph has one edge per pattern and distinct instance, so copies and frequent identifiers are one row
before the first shuffle; all steps are aggregates with map-side combine and equi-joins. Everything covers all rows.

Defined cases: null text counts as empty and has no spans. Matches of a base expression that fail its test are
dropped and not tried again from a later character. Rows that are repeated or share an id are rows of their own with
the same result. Ties of scores: the first kind. An empty table gives no rows. Other columns are ignored, whatever
their names. Long texts are read as a whole, by expressions that never look at a character more than a few times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

from .arrays import find_words, pieces, text_bytes
from .columns import text_or_empty

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: Fewest characters of an instance that is no seed.
SHORTEST = 5
#: Fewest different instances of a pattern, and what is added to their number.
SUPPORT, DOUBT = 3, 2
ROUNDS = 3
#: A score of 1, and what patterns and instances need.
ONE, SURE_PATTERN, SURE_INSTANCE = 1_000_000, 700_000, 500_000

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match of these begins with a whole run of digits, so later digits of a run need not be tried
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(rb"[^0-9]+")
_LIKE = re.compile(rb"[A-Za-z0-9@._%+\x80-\xff-]++")
_MARK = re.compile(rb"[0-9@]")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARKED = _DIGIT.copy()
_MARKED[64] = True


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _emails(text: bytes) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (here := text.find(b"@", at)) >= 0:
        local = text[max(done, at) : here]  # no at sign in it
        size = len(local) - len(local.rstrip(_LOCAL))
        found = _DOMAIN.match(text, here + 1) if size else None
        if found:
            yield here - size, found.end()
            done = found.end()
        at = here + 1


def seeds(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, begin, end) of all base spans, in bytes, by kind and place."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip(b"0")) <= 3 and int(part.lstrip(b"0") or b"0") <= 255 for part in m[0].split(b".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub(b"", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub(b"", m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def candidates(text: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(begin, end) of identifier-like strings that touch no span of ``taken``, in bytes."""
    out = []
    busy = sorted((a, b) for _, a, b in taken)
    k, reach = 0, 0
    for m in _LIKE.finditer(text):
        if not _MARK.search(m[0]):
            continue
        begin = m.start() + len(m[0]) - len(m[0].lstrip(b"._%+-"))
        end = m.end() - (len(m[0]) - len(m[0].rstrip(b"._%+-")))
        while k < len(busy) and busy[k][0] < end:
            reach = max(reach, busy[k][1])
            k += 1
        if reach <= begin and len(text[begin:end].decode("utf-8", "replace")) >= SHORTEST:
            out.append((begin, end))
    return out


def shape(instance: bytes) -> bytes:
    if b"@" in instance:
        return b"at"
    if re.search(rb"[A-Za-z\x80-\xff]", instance):
        return b"mixed"
    return b"dotted" if instance.count(b".") >= 2 else b"digits"


def _short(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for part in parts:
        h.update(len(part).to_bytes(8, "little") + part)
    return h.digest()


def _contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, begin: int, end: int) -> tuple[list[bytes], list[bytes]]:
    """Two words before and after a span, nearest first; what is glued to the span counts as a word."""
    first = int(np.searchsorted(starts, begin, side="right")) - 1
    last = int(np.searchsorted(starts, end - 1, side="right")) - 1
    text = lambda a, b: data[a:b].tobytes().lower()
    before = [text(starts[first], begin)] if starts[first] < begin else []
    after = [text(end, ends[last])] if end < ends[last] else []
    before += [text(starts[k], ends[k]) for k in range(first - 1, max(lo, first - 3 + len(before)) - 1, -1)]
    after += [text(starts[k], ends[k]) for k in range(last + 1, min(hi, last + 3 - len(after)))]
    return (before + [b"", b""])[:2], (after + [b"", b""])[:2]


def patterns(before: list[bytes], after: list[bytes], form: bytes) -> list[bytes]:
    """Digests of the patterns around a span; those without any word are none."""
    around = ((b"before", *before), (b"after", *after), (b"between", before[0], after[0]))
    return [_short(*p, form) for p in around if any(p[1:])]


_ITEM = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("inst", pa.binary()), ("pats", pa.list_(pa.binary()))])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    for batch in pieces(batches, "text", 1_000_000):
        data, offsets = text_bytes(batch.column(1))
        starts, ends, rows = find_words(data, offsets)
        marks = np.concatenate([[0], np.cumsum(_MARKED[data])])
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        items: list[list[dict]] = []
        for r in range(batch.num_rows):
            a, b = int(offsets[r]), int(offsets[r + 1])
            items.append([])
            if marks[a] == marks[b]:
                continue
            text = data[a:b].tobytes()
            spans = seeds(text)
            for kind, begin, end in [*spans, *((-1, x, y) for x, y in candidates(text, spans))]:
                own = text[begin:end].lower()
                around = _contexts(data, starts, ends, int(rows[r]), int(rows[r + 1]), a + begin, a + end)
                items[-1].append(
                    {
                        "kind": kind, "start": int(points[a + begin] - points[a]), "end": int(points[a + end] - points[a]),
                        "inst": _short(own), "pats": patterns(*around, shape(own)),
                    }
                )
        yield pa.record_batch(
            [pa.array(np.arange(number, number + batch.num_rows)), batch.column(0), pa.array(items, pa.list_(_ITEM))], ["row", "id", "items"]
        )
        number += batch.num_rows


def _per_kind(make) -> list[Column]:
    return [make(k).alias(f"s{k}") for k in range(len(KINDS))]


def discover(items: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(row, kind, start, end): occurrences in ``items`` (row, kind, start, end, inst, pats) that the graph takes for a kind."""
    found = items.select("inst", "kind", F.explode("pats").alias("pat")).distinct()
    enough = found.groupBy("pat").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    edges = cut_lineage(found.join(enough, "pat"), "pattern-edges")
    seed_scores = _per_kind(lambda k: F.when(F.col("kind") == k, ONE).otherwise(0).cast("long"))
    open_edges = edges.where("kind < 0")
    scores = None
    for i in range(rounds):
        if scores is None:
            weighted = edges.select("pat", "n", *seed_scores)
        else:
            known = open_edges.join(scores, "inst").select("pat", "n", *(f"s{k}" for k in range(len(KINDS))))
            weighted = edges.where("kind >= 0").select("pat", "n", *seed_scores).union(known)
        pattern_scores = weighted.groupBy("pat", "n").agg(*(F.sum(f"s{k}").alias(f"m{k}") for k in range(len(KINDS))))
        pattern_scores = cut_lineage(
            pattern_scores.select("pat", *_per_kind(lambda k: F.floor(F.col(f"m{k}") / (F.col("n") + DOUBT)).cast("long"))), "pattern-scores"
        )
        if i + 1 < rounds:
            means = open_edges.select("inst", "pat").join(pattern_scores, "pat").groupBy("inst")
            scores = means.agg(*_per_kind(lambda k: F.floor(F.sum(f"s{k}") / F.count("*")).cast("long")))
            scores = cut_lineage(scores, "instance-scores")
    means = open_edges.select("inst", "pat").join(pattern_scores, "pat").groupBy("inst")
    sure = means.agg(*(F.floor(F.sum(f"s{k}") / F.count("*")).alias(f"i{k}") for k in range(len(KINDS))))
    sure = sure.where(F.greatest(*(F.col(f"i{k}") for k in range(len(KINDS)))) >= SURE_INSTANCE)
    strong = pattern_scores.where(F.greatest(*(F.col(f"s{k}") for k in range(len(KINDS)))) >= SURE_PATTERN)
    places = items.where("kind < 0").select("row", "start", "end", "inst", F.explode("pats").alias("pat"))
    meant = places.join(strong, "pat").join(sure, "inst")
    options = F.filter(
        F.array(*(F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("order"), F.col(f"i{k}").alias("own")) for k in range(len(KINDS)))),
        lambda o: (o.score >= SURE_PATTERN) & (o.own >= SURE_INSTANCE),
    )
    best = meant.withColumn("option", F.array_max(options)).where("option IS NOT NULL")
    return best.groupBy("row", "start", "end").agg((-F.max("option")["order"]).alias("kind")).select("row", "kind", "start", "end")


def span_list(spans: Column) -> Column:
    """Spans (kind, start, end) as text, in the order of kinds, then places."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.kind, s.start, s.end)))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", names[s.kind], s.start, s.end)))


def find_identifiers(docs: DataFrame, id_name: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added), one row per document: base spans and discovered ones as lists of (kind, start, end).

    Kinds are numbers of ``KINDS``; places are code points, the end excluded.
    """
    given = docs.select(F.col(id_name).alias("id"), text_or_empty(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    item = "struct<kind:int,start:long,end:long,inst:binary,pats:array<binary>>"
    # rows are numbered by task and place, which the stored result keeps
    scanned = cut_lineage(given.mapInArrow(_scanned, f"row long, id {kind}, items array<{item}>"), "pii-items")
    items = scanned.select("row", F.explode("items").alias("i")).select("row", "i.*")
    added = discover(items, rounds).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    plain = F.transform(F.filter("items", lambda i: i.kind >= 0), lambda i: F.struct(i.kind.alias("kind"), i.start.alias("start"), i.end.alias("end")))
    return scanned.select("row", "id", plain.alias("base")).join(added, "row", "left").select(
        F.col("id").alias("doc_id"), "base", F.coalesce(F.col("added").cast("array<struct<kind:int,start:bigint,end:bigint>>"), none).alias("added")
    )
