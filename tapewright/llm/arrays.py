"""Array helpers shared by the operators: Arrow text columns as byte arrays, words, rolling hashes, sliding minima.

Everything works on whole batches with NumPy, so a task never loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash; odd, so that powers can be undone modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: White space between words: blank and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of ``column``, so that work arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        cuts = np.flatnonzero(np.diff(offsets[:-1] // most)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, BASE), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` gets the hash of any run of units (64-bit arithmetic wraps around)."""
    up, _ = _powers(len(units) + 1)
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units.astype(np.uint64, copy=False) * up[: len(units)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of units [start, end) for each pair."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hashes(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` units."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _powers(len(prefix))
    return mix((prefix[width:] - prefix[:-width]) * down[:n])


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of each row's words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]  # a word ends with its row
    first[edges] = word[edges]
    last[edges[1:] - 1] = word[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(data.astype(np.uint64) + np.uint64(1)), starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def super_kmers(
    units: np.ndarray, rows: np.ndarray, width: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive ``width``-unit windows of one row that share their minimiser.

    The minimiser of a window is the leftmost smallest hash among its ``gram``-unit grams, so equal windows have it at
    the same place and no two windows of one run are equal. ``rows`` has the n + 1 unit offsets of the rows. Returns
    minimiser value, hash of the units of the run, first unit and number of windows, in unit order.
    """
    n = len(units) - width + 1
    none = np.zeros(0, np.uint64)
    if n <= 0:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    prefix = prefix_hashes(units)
    grams = window_hashes(prefix, gram)
    low = np.uint64((1 << max(1, int(len(grams)).bit_length())) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, width - gram + 1) & low).astype(np.int64)
    sizes = np.diff(rows)
    inside = np.zeros(n + 1, np.int32)  # windows that lie in one row
    long_rows = sizes >= width
    np.add.at(inside, rows[:-1][long_rows], 1)
    np.add.at(inside, rows[1:][long_rows] - width + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    begins = rows[:-1][long_rows]
    new[begins] = True
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], n)
    counted = np.concatenate([[0], np.cumsum(inside)])
    windows = counted[stops] - counted[starts]
    return grams[at[starts]], span_hashes(prefix, starts, starts + windows + width - 1), starts, windows
