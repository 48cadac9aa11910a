"""Benchmark decontamination: a BM25 index of the test items, asked by every training passage.

Test items are cut into segments of at most 64 words and indexed: a posting has the BM25 weight of a term in a
segment as a share of the weight the whole segment gives itself, so a passage that contains a segment scores 1 and
one threshold serves all. Every document is cut into passages of 128 words, each 64 words after the one before, so a
segment that a document holds lies whole in one passage. Postings are kept in blocks of eight segments that know
their largest weight. For all passages of a batch at once, the largest weights of their terms are summed per block;
blocks that cannot reach the threshold are skipped, and in the others block-max WAND walks the postings, which
returns all segments at or above the threshold. Each (document, item) found is then verified: 0.8 of the five-word
shingles of the item's question must be in the document and half of the words of its answer in the passages of the
document that segments of the item were found in, with 64 words around each. The answer is the last sentence of an item, the question what is before it (an item of one sentence is both).

The index goes to executors in shards of bounded size; a benchmark larger than a shard is searched shard by shard,
with document frequencies and mean length of the whole benchmark, counted by Spark. Documents are not shuffled.

Defined cases: null or empty texts match nothing, as do items without a word. Items under five words must occur as
they are. A document row is reported once for each distinct item (id and text) it holds; repeated document rows are
reported each, repeated item rows once. A very long text is cut into passages in one row's arrays, some 50 bytes a
byte of text. An empty benchmark gives an empty result. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import pickle
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tapewright.session import cut_lineage

from .arrays import LOWER, find_words, pieces, prefix_hashes, ranges, span_hashes, text_bytes, window_hashes, word_hashes
from .columns import text_or_empty

SEGMENT = 64
#: Retrieval threshold as a share of a segment's own score.
THRESHOLD = 0.6
SHINGLE = 5
QUESTION_SHARE = 0.8
ANSWER_SHARE = 0.5
#: Segments per block of the index.
BLOCK = 8
K1, B = 1.2, 0.75
#: Bytes of item text per shard.
SHARD_BYTES = 4_000_000


def _words(text: str) -> np.ndarray:
    data, offsets = text_bytes(pa.array([text]))
    data = LOWER[data]
    starts, ends, _ = find_words(data, offsets)
    return word_hashes(data, starts, ends)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text) if x.strip()]
    if len(sentences) < 2:
        return text, text
    return " ".join(sentences[:-1]), sentences[-1]


def _shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    size = min(SHINGLE, len(words))
    prefix = prefix_hashes(words)
    return size, np.unique(span_hashes(prefix, np.arange(len(words) - size + 1), np.arange(size, len(words) + 1)))


def _segments(words: np.ndarray) -> list[np.ndarray]:
    return np.array_split(words, -(-len(words) // SEGMENT))


class BlockMaxIndex:
    """Postings with weights, in blocks that know their last segment and largest weight."""

    def __init__(self, items: list[tuple[object, str]], statistics: tuple[int, int, np.ndarray, np.ndarray] | None = None):
        """``statistics``: segments, words, terms (ascending) and segments of each term in the whole benchmark, where
        ``items`` are only a part of it."""
        self.items, segments = [], []
        for item, text in items:
            words = _words(text or "")
            if not len(words):
                continue
            question, answer = split_item(text)
            self.items.append((item, _shingles(_words(question)), np.unique(_words(answer))))
            for part in _segments(words):
                segments.append((len(self.items) - 1, np.unique(part, return_counts=True), len(part)))
        self.item_of = [i for i, _, _ in segments]
        everything = np.concatenate([t for _, (t, _), _ in segments]) if segments else np.zeros(0, np.uint64)
        self.terms, df = np.unique(everything, return_counts=True)
        count, total = len(segments), sum(n for _, _, n in segments)
        if statistics is not None:
            count, total, terms, held = statistics
            df = held[np.searchsorted(terms, self.terms)]
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        mean = total / max(1, count)
        docs: list[list[int]] = [[] for _ in self.terms]
        weights: list[list[float]] = [[] for _ in self.terms]
        for s, (_, (terms, tf), n) in enumerate(segments):
            at = np.searchsorted(self.terms, terms)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
            for t, x in zip(at.tolist(), (w / w.sum()).tolist(), strict=True):
                docs[t].append(s)
                weights[t].append(x)
        self.docs, self.weights = docs, weights
        self.largest = np.array([max(w) for w in weights])
        # each term's blocks and the largest weight in them, one term after the other
        pairs = [(t, d // BLOCK, x) for t, (ds, ws) in enumerate(zip(docs, weights, strict=True)) for d, x in zip(ds, ws, strict=True)]
        terms_of = np.array([t for t, _, _ in pairs], np.int64)
        blocks_of = np.array([b for _, b, _ in pairs], np.int64)
        first = np.flatnonzero(np.append(True, (terms_of[1:] != terms_of[:-1]) | (blocks_of[1:] != blocks_of[:-1]))[: len(pairs)])
        self.block = blocks_of[first]
        self.block_max = np.maximum.reduceat(np.array([x for _, _, x in pairs]), first) if len(pairs) else np.zeros(0)
        self.block_start = np.searchsorted(terms_of[first], np.arange(len(self.terms) + 1))

    def promising(self, passage: np.ndarray, terms: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose bound reaches the threshold, given the distinct terms of all passages."""
        size = self.block_start[terms + 1] - self.block_start[terms]
        at = ranges(self.block_start[terms], size)
        key = np.repeat(passage, size).astype(np.uint64) << np.uint64(32) | self.block[at].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        good = np.add.reduceat(self.block_max[at[order]], first) >= threshold - 1e-9 if len(first) else np.zeros(0, bool)
        key = key[first[good]]
        return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def search(self, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """Segments of the block whose weights for ``terms`` sum to the threshold or more, by WAND with its bounds."""
        least, stop = threshold - 1e-9, (block + 1) * BLOCK
        cursors = []  # segment, largest weight in the block, segments, weights, place
        for t in terms:
            docs = self.docs[t]
            at = bisect.bisect_left(docs, block * BLOCK)
            if at < len(docs) and docs[at] < stop:
                own = slice(self.block_start[t], self.block_start[t + 1])
                cursors.append([docs[at], self.block_max[own][np.searchsorted(self.block[own], block)], docs, self.weights[t], at])
        found = []

        def forward(cursor: list, to: int) -> None:
            at = cursor[4] = bisect.bisect_left(cursor[2], to, cursor[4])
            cursor[0] = cursor[2][at] if at < len(cursor[2]) else stop

        while True:
            cursors = sorted((c for c in cursors if c[0] < stop), key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[1]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            segment = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == segment:
                pivot += 1
            if cursors[0][0] == segment:
                score = sum(c[3][c[4]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((segment, score))
                for c in cursors[: pivot + 1]:
                    forward(c, segment + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < segment:
                        forward(c, segment)


def passages(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and past-the-last word of the passages of texts with the given word offsets."""
    sizes = np.diff(rows)
    blocks = -(-sizes // SEGMENT)
    count = np.where(blocks > 1, blocks - 1, blocks)
    row = np.repeat(np.arange(len(sizes)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = rows[row] + within * SEGMENT
    return row, first, np.minimum(first + 2 * SEGMENT, rows[row + 1])


def search_batch(texts: pa.Array, index: BlockMaxIndex, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
    """(row, item number, score, question share, answer share) of all verified matches, one per row and item."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    if not len(words) or not len(index.terms):
        return []
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[term] == words)
    row, first, last = passages(rows)
    # a word at a multiple of 64 words from the start of its text begins a block; a passage is two blocks
    base = np.searchsorted(row, np.arange(len(rows)))  # first passage of each row
    own = np.searchsorted(rows, known, side="right") - 1
    block = (known - rows[own]) // SEGMENT
    passages_of = base[own + 1] - base[own]
    keys = []
    for shift in (0, 1):
        ok = (block - shift >= 0) & (block - shift < passages_of)
        keys.append(((base[own] + block - shift)[ok].astype(np.uint64) << np.uint64(32)) | term[known[ok]].astype(np.uint64))
    keys = np.unique(np.concatenate(keys))
    passage, terms = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    bound = np.bincount(passage, weights=index.largest[terms], minlength=len(row))
    able = bound[passage] >= threshold - 1e-9
    passage, terms = passage[able], terms[able]
    asked, block = index.promising(passage, terms, threshold)
    lo, hi = np.searchsorted(passage, asked), np.searchsorted(passage, asked, side="right")
    found: dict[tuple[int, int], tuple[float, set[int]]] = {}  # best score and all passages
    for p, k, a, b in zip(asked.tolist(), block.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for segment, score in index.search(terms[a:b].tolist(), threshold, k):
            key = int(row[p]), index.item_of[segment]
            best_score, places = found.get(key, (0.0, set()))
            places.add(p)
            found[key] = max(best_score, score), places
    out, grams = [], {}
    prefix = prefix_hashes(words) if found else None
    for (r, i), (score, places) in found.items():
        _, (size, shingles), answer = index.items[i]
        if size not in grams:
            grams[size] = window_hashes(prefix, size)
        here = grams[size][rows[r] : max(rows[r], rows[r + 1] - size + 1)]
        question_share = float(np.isin(shingles, here).mean())
        near = np.zeros(rows[r + 1] - rows[r], bool)  # an item of several segments is found in several passages
        for p in places:
            near[max(0, first[p] - SEGMENT - rows[r]) : last[p] + SEGMENT - rows[r]] = True
        answer_share = float(np.isin(answer, words[rows[r] : rows[r + 1]][near]).mean())
        if question_share >= QUESTION_SHARE and answer_share >= ANSWER_SHARE:
            out.append((r, i, score, question_share, answer_share))
    return sorted(out)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, segments, words) per item; a row without a term counts its segments and words."""
    for batch in batches:
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = _words(text)
            if not len(words):
                continue
            parts = _segments(words)
            terms, held = np.unique(np.concatenate([np.unique(x) for x in parts]), return_counts=True)
            yield pa.record_batch(
                [
                    pa.array([shard] * (len(terms) + 1), pa.int32()),
                    pa.array([None, *terms.view(np.int64).tolist()], pa.int64()),
                    pa.array([len(parts), *held.tolist()], pa.int64()),
                    pa.array([len(words)] + [0] * len(terms), pa.int64()),
                ],
                ["shard", "term", "segments", "words"],
            )


def _builder(count: int, total: int):
    def build(items: pa.Table, held: pa.Table) -> pa.Table:
        terms = held.column("term").to_numpy().view(np.uint64)
        order = np.argsort(terms)
        known = count, total, terms[order], held.column("df").to_numpy()[order]
        rows = sorted(zip(items.column("item_id").to_pylist(), items.column("t").to_pylist(), strict=True), key=lambda x: (str(x[0]), x[1]))
        shard = items.column("shard").slice(0, 1).combine_chunks()
        return pa.table({"shard": shard, "index": pa.array([pickle.dumps(BlockMaxIndex(rows, known))], pa.binary())})

    return build


def _indexes(items: DataFrame, item_id: str, item_text: str) -> list:
    """Broadcast indexes of the shards; each holds at most about ``SHARD_BYTES`` of item text.

    Executors count the terms of the whole benchmark and build the shards from those counts, so neither scores nor
    findings depend on how it is cut. The driver passes on one finished index after the other.
    """
    spark = items.sparkSession
    given = items.select(F.col(item_id).alias("item_id"), text_or_empty(item_text).alias("t")).distinct()
    given = given.where(F.col("t").rlike(r"[^\x20\x09-\x0D]"))
    size = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if not size:
        return [spark.sparkContext.broadcast(BlockMaxIndex([]))]
    shards = -(-2 * size // SHARD_BYTES)  # half full on average
    cut = given.select(F.pmod(F.xxhash64("item_id", "t"), F.lit(shards)).cast("int").alias("shard"), "item_id", "t")
    counted = cut.mapInArrow(_statistics, "shard int, term long, segments long, words long")
    counted = cut_lineage(counted.groupBy("shard", "term").agg(F.sum("segments").alias("segments"), F.sum("words").alias("words")), "item-terms")
    count, total = counted.where("term is null").agg(F.sum("segments"), F.sum("words")).first()
    terms = counted.where("term is not null")
    held = terms.select("shard", "term").join(terms.groupBy("term").agg(F.sum("segments").alias("df")), "term")
    built = cut.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_builder(count, total), "shard int, index binary")
    built = cut_lineage(built, "item-index")
    out = []
    for k in range(shards):
        index = built.where(F.col("shard") == k).first()
        if index is not None:
            out.append(spark.sparkContext.broadcast(pickle.loads(index["index"])))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, id_name: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share): documents that hold a test item.

    One row per row of ``docs`` and distinct item (id and text) that it holds; equal scores are no tie to break, since
    all items over the threshold are returned.
    """
    asked = docs.select(F.col(id_name).alias("doc_id"), text_or_empty(text).alias("text"))
    kinds = (
        f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, "
        "score double, question_share double, answer_share double"
    )
    arrow_item = to_arrow_type(items.schema[item_id].dataType)

    def of_shard(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in pieces(batches, "text"):
                found = search_batch(batch.column(1), index, threshold)
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                columns = [pa.array([x[k] for x in found], pa.float64()) for k in (2, 3, 4)]
                yield pa.record_batch(
                    [ids, pa.array([index.items[x[1]][0] for x in found], arrow_item), *columns],
                    ["doc_id", "item_id", "score", "question_share", "answer_share"],
                )

        return asked.mapInArrow(run, kinds)

    return reduce(DataFrame.union, map(of_shard, _indexes(items, item_id, item_text)))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    asked = docs.toDF(*names)
    own = f"c{docs.columns.index(text)}"

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, own, 500_000):
                stays = np.ones(batch.num_rows, bool)
                for r, *_ in search_batch(batch.column(names.index(own)), shared.value, threshold):
                    stays[r] = False
                yield batch.filter(pa.array(stays))

        return run

    for shared in _indexes(items, item_id, item_text):
        asked = asked.mapInArrow(clean(shared), schema)
    return asked.toDF(*docs.columns)
