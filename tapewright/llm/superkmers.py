"""Substring deduplication by words: super-k-mer partitioning.

A window is 50 consecutive words of one document. A word goes when some window that covers it has a word sequence
that also starts in a document with a smaller id. Windows that share their minimiser travel as one packed string to
the bucket of the minimiser; there the windows of all its strings are sorted, and the smallest id of each group of
equal windows decides. Groups are formed by a hash of the word numbers and then compared word by word, so two
different windows never count as one. See ``windows`` for what is shuffled when.

Defined cases: null text has no words. A null id counts as greater than all ids. Rows with the same id are one
document for the comparison of ids, so they never remove words from each other; a row that occurs twice gets the same
result twice. Texts under 50 words stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import find_words, pieces, prefix_hashes, ranges, text_bytes, window_hashes
from .windows import attach_ranges, kept_and_removed, keyed, real_id, repeated_windows, runs_of

WIDTH = 50
#: Words per gram of the minimiser.
GRAM = 10


def equal_groups(units: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts in an order that brings equal windows together, and where each group begins in it."""
    hashes = window_hashes(prefix_hashes(units), width)[starts]
    order = np.argsort(hashes, kind="stable")
    at, sorted_hashes = starts[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    pairs = np.flatnonzero(~new)
    differ = np.zeros(len(pairs), bool)
    for k in range(width):
        differ |= units[at[pairs] + k] != units[at[pairs - 1] + k]
    if differ.any():  # different windows with one hash: order by the words themselves
        order = np.lexsort([units[starts + k] for k in range(width - 1, -1, -1)])
        at = starts[order]
        new[1:] = np.any([units[at[1:] + k] != units[at[:-1] + k] for k in range(width)], axis=0)
    return at, new


def judge_windows(packed: pa.Array, copies: np.ndarray, first: np.ndarray, width: int):
    """Ranges of windows with the smallest id that has them, where that id is not the run's own smallest or copies exist."""
    data, offsets = text_bytes(packed)
    begins, ends, rows = find_words(data, offsets)
    edges = np.append(begins, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    units = words.dictionary_encode().indices.to_numpy().astype(np.uint64)  # each word with the one blank after it
    windows = np.diff(rows) - width + 1
    starts = ranges(rows[:-1], windows)
    run = np.repeat(np.arange(len(windows)), windows)
    at, new = equal_groups(units, starts, width)
    smallest = np.minimum.reduceat(first[np.searchsorted(rows, at, side="right") - 1], np.flatnonzero(new))[np.cumsum(new) - 1]
    known = np.empty(len(units), np.int64)
    known[at] = smallest
    known = known[starts]
    lo, hi = runs_of(np.ones(len(starts), bool), run, known)
    base = starts[lo] - rows[run[lo]]
    return run[lo], base, base + hi - lo, known[lo]


def dedup_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_name: str = "doc_id", text: str = "text",
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) and the columns named in ``carry``: the words that stay, joined by one blank."""
    found = repeated_windows(keyed(docs, id_name, text), "word", width, gram, judge_windows, later_only=True)
    rows = keyed(docs, id_name, text, carry)
    extra = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 500_000):
            data, offsets = text_bytes(batch.column(1))
            starts, ends, rows = find_words(data, offsets)
            kept, removed = [], []
            for i, cuts in enumerate(batch.column(2)):
                lo, hi = rows[i], rows[i + 1]
                stay = np.ones(hi - lo, bool)
                if cuts.is_valid:
                    begin, end = (cuts.values.field(k).to_numpy() for k in ("begin", "end"))
                    for a, b in zip(*kept_and_removed(hi - lo, begin, end), strict=True):
                        stay[a:b] = False
                s, e = starts[lo:hi][stay], ends[lo:hi][stay]
                sizes = e - s + 1
                text = data[np.minimum(ranges(s, sizes), max(len(data) - 1, 0))]
                text[np.cumsum(sizes) - 1] = 32
                kept.append(text[:-1].tobytes().decode("utf-8", "replace"))
                removed.append(hi - lo - len(s))
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(rows)), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *batch.columns[3:]],
                ["doc_id", "n_words", "n_removed", "kept", *extra],
            )

    given = attach_ranges(rows, found).select(real_id().alias("doc_id"), "text", "cuts", *extra)
    kinds = "".join(f", {c} {given.schema[c].dataType.simpleString()}" for c in extra)
    out = given.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string" + kinds)
    return out.select("doc_id", "n_words", "n_removed", "kept", *(F.col(c).alias(name) for c, name in zip(extra, carry, strict=True)))
