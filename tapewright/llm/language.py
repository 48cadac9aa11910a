"""Language identification by prediction by partial matching.

For every language a variable-order context tree over bytes is learned: how often each byte followed each context of
0 to ``order`` bytes. The statistics are then frozen. A byte seen c times after a context that was seen n times with t
different bytes costs -log2(c / (n + t)) bits there; otherwise an escape, -log2(t / (n + t)) bits, is paid and the
context loses its first byte; below the empty context a byte costs 8 bits. The code length of a whole text under each
language is exact, and the shortest wins.

The trees of all languages share one set of nodes, so a text is walked once: level by level, arrays hold the node of
every position, and costs of all languages are read as rows. Rows are independent; the only thing sent to executors
is the compiled model, whose size follows from ``sample_bytes``, not from the data.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is everything when no labelled text
exists. Equal code lengths: the first language by name. Labels that are null are not learned from. Repeated rows each
get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pieces, text_bytes
from .columns import text_or_empty

UNDETERMINED = "und"
#: Longest context in bytes.
ORDER = 4
#: Bytes of labelled text that are learned per language, taken as distinct texts in the order of a content hash.
SAMPLE_BYTES = 300_000


class ContextTrees:
    """Compiled code lengths of all languages.

    ``step[k]`` leads from a (k-1)-byte string and the next byte to the k-byte string (0: never seen); ``cost[k]`` has
    the bits of its last byte after the bytes before it, and ``escape[k]`` the bits of leaving it as a context.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages = sorted(samples)
        self.depth, many = order + 1, len(self.languages)
        texts = [(i, x) for i, name in enumerate(self.languages) for x in samples[name] if x]
        data = np.frombuffer(b"".join(x for _, x in texts), np.uint8)
        sizes = np.array([len(x) for _, x in texts], np.int64)
        language = np.repeat(np.array([i for i, _ in texts], np.int64), sizes)
        into = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = np.unique(data)
        self.letters = len(seen)
        self.letter = np.full(256, self.letters, np.uint8 if self.letters < 255 else np.uint16)
        self.letter[seen] = np.arange(self.letters)
        self.step, self.cost, self.escape = [None], [None], []
        code, below, below_cost = np.zeros(len(data), np.uint64), None, None
        for k in range(1, self.depth + 1):
            code = (np.concatenate([code[:1] * 0, code[:-1]]) << np.uint64(8)) | data  # the last k bytes as one number
            whole = into >= k - 1
            nodes, at = np.unique(code[whole], return_inverse=True)
            counts = np.bincount(at * many + language[whole], minlength=len(nodes) * many).reshape(len(nodes), many).astype(float)
            if k == 1:
                before, shorter = np.zeros(len(nodes), np.int64), None
            else:
                before = np.searchsorted(below, nodes >> np.uint64(8)) + 1
                shorter = np.searchsorted(below, nodes & np.uint64((1 << 8 * (k - 1)) - 1)) + 1
            kinds = np.zeros((len(below) + 1 if below is not None else 1, many))
            np.add.at(kinds, before, counts > 0)
            sums = np.zeros_like(kinds)
            np.add.at(sums, before, counts)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(sums > 0, -np.log2(kinds / (sums + kinds)), 0.0)
                stay = -np.log2(counts / (sums + kinds)[before])
            rest = 8.0 if k == 1 else below_cost[shorter]
            here = np.where(counts > 0, stay, leave[before] + rest)
            step = np.zeros((len(kinds), self.letters + 1), np.int32)
            step[before, self.letter[(nodes & np.uint64(255)).astype(np.int64)]] = np.arange(1, len(nodes) + 1)
            self.step.append(step)
            self.cost.append(np.concatenate([np.zeros((1, many)), here]).astype(np.float32))
            self.escape.append(leave.astype(np.float32))
            below, below_cost = nodes, self.cost[-1]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row under every language."""
        many, rows = len(self.languages), len(offsets) - 1
        out = np.zeros((rows, many))
        if not len(data) or not many:
            return out
        letters = self.letter[data]
        first = offsets[:-1][np.diff(offsets) > 0]
        node, before = [None], [np.zeros(len(data), np.int32)]
        for k in range(1, self.depth + 1):
            node.append(self.step[k][before[-1], letters])
            if k > 1:
                node[k][before[-1] == 0] = 0
            shifted = np.empty_like(node[k])
            shifted[1:] = node[k][:-1]
            shifted[first] = 0
            before.append(shifted)
        bits = self.cost[self.depth][node[self.depth]]
        left = np.flatnonzero(node[self.depth] == 0)
        for k in range(self.depth, 0, -1):
            bits[left] += self.escape[k - 1][before[k - 1][left]]
            if k == 1:
                bits[left] += 8.0
                break
            known = node[k - 1][left]
            bits[left] += self.cost[k - 1][known]
            left = left[known == 0]
        out[np.diff(offsets) > 0] = np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out


def labelled_sample(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, lang: str = "lang", text: str = "text") -> dict[str, list[bytes]]:
    """At most ``sample_bytes`` of distinct texts per language, chosen by a hash of their content.

    The share of a language is the bound over the bytes of its distinct texts, so no language is ordered or gathered
    as a whole. A text over a tenth of the bound is left to the others where those fill the bound. Where they do not,
    such texts follow by their hash; the last of them is cut at the bound.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    rows = rows.withColumn("n", F.octet_length("text")).withColumn("h", F.xxhash64("text"))
    short = F.col("n") <= sample_bytes // 10
    # copies are one row of (language, hash, bytes) from here on; per language come back its bytes and its first long texts
    distinct = rows.groupBy("lang", "h").agg(F.min("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.sum(F.when(short, F.col("n")).otherwise(0)).alias("n")).collect()}
    scarce = [name for name, n in totals.items() if n < sample_bytes]
    # each is over a tenth of the bound, so ten of them fill it
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    following = distinct.where(F.col("lang").isin(scarce) & ~short).withColumn("k", rank).where("k <= 10").collect() if scarce else []
    share = F.create_map(*(F.lit(x) for name, n in totals.items() for x in (name, sample_bytes / max(n, 1)))) if totals else None
    chosen = rows.where(short & ((F.col("h").cast("double") / 2.0**63 + 1) / 2 <= share[F.col("lang")])) if totals else rows.limit(0)
    samples: dict[str, list[bytes]] = {name: [] for name in totals}
    room = dict.fromkeys(samples, sample_bytes)
    for r in chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h", "text").toLocalIterator():
        data = r["text"].encode()
        if len(data) <= room[r["lang"]]:
            room[r["lang"]] -= len(data)
            samples[r["lang"]].append(data)
    if following:
        asked = {(r["lang"], r["h"]) for r in following}
        longer = rows.where(~short & F.col("lang").isin(scarce) & F.col("h").isin([h for _, h in asked]))
        longer = longer.select("lang", "h", F.substring("text", 1, sample_bytes).alias("text"))
        for r in longer.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").toLocalIterator():
            data = r["text"].encode()[: room[r["lang"]]].decode("utf-8", "ignore").encode()  # ends with a whole character
            if (r["lang"], r["h"]) in asked and data:
                room[r["lang"]] -= len(data)
                samples[r["lang"]].append(data)
    return {k: v for k, v in samples.items() if v}


def train(labelled: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> ContextTrees:
    return ContextTrees(labelled_sample(labelled, sample_bytes), order)


def identify(docs: DataFrame, model: ContextTrees, id_name: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) and the columns named in ``carry``, one row per document.

    ``score`` is the share of the best language among all when each is weighted by 2 to the minus its code length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = (id_name, *carry)
    # a text that is carried anyway travels once
    own = carried.index(text) if text in carried else len(carried)
    given = docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)),
        *([] if text in carried else [text_or_empty(text).alias(f"c{own}")]),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    names = [f"c{i}" for i in range(len(carried))]
    kinds = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in pieces(batches, f"c{own}", 250_000):
            data, offsets = text_bytes(batch.column(own))
            bits = trees.code_lengths(data, offsets)
            sizes = np.diff(offsets)
            known = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) & (len(trees.languages) > 0)
            if bits.shape[1]:
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = np.where(known, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1), 0.0)
                rate = np.where(known, least / np.maximum(sizes, 1), 0.0)
                names_of = np.array([*trees.languages, UNDETERMINED], object)[np.where(known, best, len(trees.languages))]
            else:
                score = rate = np.zeros(len(sizes))
                names_of = np.full(len(sizes), UNDETERMINED, object)
            yield pa.record_batch(
                [*batch.columns[: len(names)], pa.array(names_of, pa.string()), pa.array(score), pa.array(rate)],
                [*names, "lang_pred", "score", "bits_per_byte"],
            )

    out = given.mapInArrow(run, f"{kinds}, lang_pred string, score double, bits_per_byte double")
    return out.select(
        F.col("c0").alias("doc_id"), *(F.col(f"c{i + 1}").alias(c) for i, c in enumerate(carry)), "lang_pred", "score", "bits_per_byte"
    )
