"""Substring deduplication by bytes: suffix arrays made by two-stage sorting.

A byte goes when a 200-byte string that covers it also starts anywhere else, in its own document or another. The
distinct runs of one minimiser (see ``windows``) meet in a bucket. Their concatenation gets a suffix array for the
suffixes that start a 200-byte string:

* a suffix smaller than its successor is sorted directly, by its first 200 bytes, eight at a time;
* all others are induced: buckets of one first byte are scanned in order, and every suffix found puts the one that
  starts a byte earlier, if that is greater, at the end of its own bucket's front part.

Adjacent common prefixes of 200 bytes or more then mark the strings that occur more than once.

Defined cases: null text counts as empty. Matches never cross documents. Rows with the same id and text are separate
documents whose strings repeat, as are rows with the same id and other texts. Texts under 200 bytes stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import pieces, ranges, text_bytes
from .windows import attach_ranges, kept_and_removed, keyed, real_id, repeated_windows, runs_of

WIDTH = 200
#: Bytes per gram of the minimiser.
GRAM = 24


def _eights(data: np.ndarray, width: int) -> np.ndarray:
    """The eight bytes from each position as one number in text order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(width + 16, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data) + width + 8].copy().view(">u8").ravel().astype(np.uint64)


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """For each suffix whether it is smaller than the suffix after it; the empty one is the smallest."""
    n = len(data)
    step = np.full(n, -1, np.int16)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    where = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def direct_sort(eights: np.ndarray, positions: np.ndarray, width: int) -> np.ndarray:
    """Positions ordered by their first ``width`` bytes; ties keep their order. Only ties are looked at again."""
    _, rank = np.unique(eights, return_inverse=True)
    rank = rank.astype(np.uint64)
    order = positions[np.argsort(rank[positions], kind="stable")]
    group = np.zeros(len(order), np.uint64)
    group[1:] = np.cumsum(rank[order[1:]] != rank[order[:-1]])
    shift = np.uint64(max(1, int(rank.max()).bit_length())) if len(rank) else np.uint64(1)
    depth = 8
    active = np.arange(len(order))
    while depth < width and len(active):
        g = group[active]
        tied = np.zeros(len(active), bool)
        same = g[1:] == g[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        active = active[tied]
        if not len(active):
            break
        g = group[active]
        key = (g << shift) | rank[order[active] + depth]
        inner = np.argsort(key, kind="stable")
        order[active], key = order[active][inner], key[inner]
        new = np.zeros(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        # from here on the number of a group is the place of its first suffix
        first = np.zeros(len(key), np.int64)
        first[new] = active[new]
        start_of_group = np.ones(len(key), bool)
        start_of_group[1:] = g[1:] != g[:-1]
        first[start_of_group] = active[start_of_group]
        group[active] = np.maximum.accumulate(first).astype(np.uint64)
        depth += 8
    return order


def sorted_suffixes(data: np.ndarray, wanted: np.ndarray, width: int, eights: np.ndarray) -> np.ndarray:
    """The ``wanted`` suffixes (a mask) in the order of their first ``width`` bytes, by two-stage sorting."""
    n = len(data)
    small = np.append(smaller_than_next(data), True)  # the empty suffix at n leads everything
    nearest = np.minimum.accumulate(np.where(small, np.arange(n + 1), n)[::-1])[::-1]
    need = np.append(wanted, False)
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    need[ranges(ends, nearest[ends] - ends + 1)] = True  # what induces the last wanted suffixes
    direct = direct_sort(eights, np.flatnonzero(need[:n] & small[:n]), width)
    heads = data[direct]
    split = np.searchsorted(heads, np.arange(257))
    front: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray, above: int) -> None:
        earlier = found[found > 0] - 1
        earlier = earlier[need[earlier] & ~small[earlier]]
        letters = data[earlier]
        earlier, letters = earlier[letters > above], letters[letters > above]
        by_letter = np.argsort(letters, kind="stable")
        earlier, letters = earlier[by_letter], letters[by_letter]
        edges = np.searchsorted(letters, np.arange(257))
        for letter in np.flatnonzero(np.diff(edges)):
            front[letter].append(earlier[edges[letter] : edges[letter + 1]])

    out = []
    if need[n]:
        induce(np.array([n]), -1)
    for letter in range(256):
        part = front[letter]
        newest = np.concatenate(part) if part else np.zeros(0, np.int64)
        whole = [newest]
        while len(newest):  # suffixes that begin with this byte more than once
            earlier = newest[newest > 0] - 1
            newest = earlier[need[earlier] & ~small[earlier] & (data[earlier] == letter)]
            whole.append(newest)
        bucket = np.concatenate([*whole, direct[split[letter] : split[letter + 1]]])
        induce(bucket, letter)
        out.append(bucket)
    result = np.concatenate(out)
    return result[wanted[result]]


def common_prefixes(eights: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common bytes, up to ``width``, of each suffix and the one before it in the order (0 for the first)."""
    common = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for depth in range(0, width, 8):
        a, b = eights[order[going] + depth], eights[order[going - 1] + depth]
        diff = a ^ b
        equal = diff == 0
        bits = np.frexp(diff[~equal].astype(np.float64))[1]
        # rounding to a float may carry into the next bit, never past a byte that is 255 throughout
        bits -= (diff[~equal] >> (bits - 1).astype(np.uint64).clip(max=63)) == 0
        common[going[~equal]] = depth + (64 - bits) // 8
        going = going[equal]
    common[going] = width
    return np.minimum(common, width)


def judge_suffixes(packed: pa.Array, copies: np.ndarray, first: np.ndarray, width: int):
    """Ranges of windows that occur more than once."""
    data, rows = text_bytes(packed)
    windows = np.diff(rows) - width + 1
    starts = ranges(rows[:-1], windows)
    run = np.repeat(np.arange(len(windows)), windows)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    eights = _eights(data, width)
    order = sorted_suffixes(data, wanted, width, eights)
    new = common_prefixes(eights, order, width) < width
    owner = np.empty(len(data), np.int64)
    owner[starts] = run
    many = np.add.reduceat(copies[owner[order]], np.flatnonzero(new)) > 1 if len(order) else np.zeros(0, bool)
    repeated = np.zeros(len(data), bool)
    repeated[order] = many[np.cumsum(new) - 1]
    lo, hi = runs_of(repeated[starts], run, run)
    base = starts[lo] - rows[run[lo]]
    return run[lo], base, base + hi - lo, first[run[lo]]


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): removed byte ranges [begin, end) and the bytes that stay."""
    rows = keyed(docs, id_name, text)
    found = repeated_windows(rows, "byte", width, gram, judge_suffixes, later_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            kept, removed, spans = [], [], []
            for i, cuts in enumerate(batch.column(2)):
                own, size = data[offsets[i] : offsets[i + 1]], int(offsets[i + 1] - offsets[i])
                pairs, n = [], 0
                if cuts.is_valid:
                    begin, end = (cuts.values.field(k).to_numpy() for k in ("begin", "end"))
                    lo, hi = kept_and_removed(size, begin, end)
                    stay = np.ones(size, bool)
                    for a, b in zip(lo, hi, strict=True):
                        stay[a:b] = False
                    pairs, n = [{"begin": a, "end": b} for a, b in zip(lo, hi, strict=True)], int((hi - lo).sum())
                    own = own[stay]
                kept.append(own.tobytes())
                removed.append(n)
                spans.append(pairs)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return (
        attach_ranges(rows, found)
        .select(real_id().alias("doc_id"), "text", "cuts")
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept binary")
    )
