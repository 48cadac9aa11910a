"""Periodic stretches of words: runs found on a harmonic grid with difference-cover longest common extensions.

A run is a maximal stretch of consecutive words with smallest period q and at least ``max(LEAST, POWER * q)`` words.
For every period q the grid has the words 0, 3q, 6q and so on. A run of 4q words always holds a grid word and the word
q after it, so from each such equal pair the common extension to the right and to the left gives the run.

Extensions are answered from a sample of all suffixes, those at places whose remainder modulo 21 is in a difference
cover. For any two places some shift under 21 leads both into the sample, so a few words are compared and then

* the sampled suffixes are sorted, two words at a time up to 21 words and from there on by the ranks of the sampled
  suffixes that follow, doubling each time;
* the common prefixes of neighbours in that order stand in a sparse table, whose minimum over the ranks in between is
  the common prefix of any two.

Rows are independent and many of them are worked on in one NumPy batch, so nothing is shuffled. Words get exact
numbers, never hashes.

Defined cases: null or blank text has no words and no runs; its digests are those of empty text. A null id counts as
empty text for the rewriting of ``op11``. Equal lengths: the smallest start, then the smallest period leads. Repeated
rows each get the same answer; an empty table gives none. Other columns are ignored, whatever their names. A text is
worked on as a whole, so one of n words takes some 100 n bytes; the grid is walked in blocks of ``BLOCK`` pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import find_words, pieces, ranges, text_bytes
from .columns import text_or_empty

#: Fewest words of a run, and fewest repetitions of its period.
LEAST, POWER = 6, 4
#: A difference cover: every remainder is the difference of two of these modulo ``MODULUS``.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
#: Grid pairs looked at together.
BLOCK = 1_000_000

_IN_COVER = np.isin(np.arange(MODULUS), COVER)
_PLACE = np.arange(MODULUS)
_BOTH = _IN_COVER[(_PLACE[:, None, None] + _PLACE) % MODULUS] & _IN_COVER[(_PLACE[None, :, None] + _PLACE) % MODULUS]
#: Smallest shift that brings two places, given by their remainders, into the cover.
SHIFT = _BOTH.argmax(axis=2)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One number per distinct word."""
    sizes = ends - starts
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    packed = data[ranges(starts, sizes)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class CommonExtensions:
    """How many units agree from two places on. ``units`` ends with a value that occurs nowhere else."""

    def __init__(self, units: np.ndarray):
        self.units = units
        n = len(units)
        self.places = np.flatnonzero(_IN_COVER[np.arange(n) % MODULUS])
        self._ordinal = np.full(n + MODULUS, -1, np.int64)
        self._ordinal[self.places] = np.arange(len(self.places))
        names = self._sorted()
        order = np.argsort(names[-1], kind="stable")
        self._rank = np.empty(len(order), np.int64)
        self._rank[order] = np.arange(len(order))
        self._table = self._minima(self._neighbours(order, names))

    def _sorted(self) -> list[np.ndarray]:
        """Names of the sampled suffixes by their first 21, 42, 84, ... units, in text order, until all differ."""
        padded = np.concatenate([self.units, np.full(2 * MODULUS, self.units[-1])])
        order = np.arange(len(self.places))
        name = np.zeros(len(order), np.int64)  # of each place in ``order``: where its group begins
        active = np.arange(len(order))
        for depth in range(0, MODULUS, 2):
            at = self.places[order[active]] + depth
            second = padded[at + 1] if depth + 1 < MODULUS else np.zeros(len(at), np.int64)
            active = self._split(order, name, active, (second, padded[at]))
        names, width = [self._by_place(order, name)], MODULUS
        while len(active):
            # equal so far, so the places ``width`` further on are sampled units of the text, too
            further = names[-1][self._ordinal[self.places[order[active]] + width]]
            active = self._split(order, name, active, (further,))
            names.append(self._by_place(order, name))
            width *= 2
        return names

    @staticmethod
    def _by_place(order: np.ndarray, name: np.ndarray) -> np.ndarray:
        out = np.empty_like(name)
        out[order] = name
        return out

    @staticmethod
    def _split(order: np.ndarray, name: np.ndarray, active: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Sort the groups of ``active`` by ``keys`` (the last one counts first); returns what is still tied."""
        if not len(active):
            return active
        group = name[active]
        inner = np.lexsort((*keys, group))
        order[active] = order[active][inner]
        new = np.ones(len(active), bool)
        new[1:] = group[1:] != group[:-1]  # groups keep their places
        for key in keys:
            key = key[inner]
            new[1:] |= key[1:] != key[:-1]
        name[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        alone = new & np.append(new[1:], True)
        return active[~alone]

    def _neighbours(self, order: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Common units of each sampled suffix and the one before it in the order (0 for the first)."""
        common = np.zeros(len(order), np.int64)
        a, b = self.places[order[1:]].copy(), self.places[order[:-1]].copy()
        for k in range(len(names) - 1, -1, -1):
            i, j = self._ordinal[a], self._ordinal[b]
            same = np.flatnonzero(names[k][i] == names[k][j]) if len(a) else np.zeros(0, np.int64)
            width = MODULUS << k
            common[1:][same] += width
            a[same] += width
            b[same] += width
        return common + np.concatenate([[0], self._compared(a, b, np.full(len(a), MODULUS))])[: len(order)]

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, step = [values], 1
        while 2 * step <= len(values):
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
            step *= 2
        return table

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Units that agree from each pair of places on, at most ``most`` of them."""
        out = np.zeros(len(i), np.int64)
        going = np.flatnonzero(most > 0)
        k = 0
        while len(going):
            going = going[self.units[i[going] + k] == self.units[j[going] + k]]
            k += 1
            out[going] = k
            going = going[most[going] > k]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, shift)
        on = np.flatnonzero(out == shift)
        one, two = self._rank[self._ordinal[i[on] + shift[on]]], self._rank[self._ordinal[j[on] + shift[on]]]
        low, high = np.minimum(one, two) + 1, np.maximum(one, two)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            part = self._table[k]
            out[on[here]] += np.minimum(part[low[here]], part[high[here] - (1 << int(k)) + 1])
        return out


def find_runs(units: np.ndarray, rows: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, past-the-last unit and period of all runs, ordered by start and period.

    ``rows`` has the n + 1 offsets of the rows among ``units``; no run crosses them. ``power`` is at least 2.
    """
    sizes = np.diff(rows)
    none = np.zeros(0, np.int64)
    if not len(units) or sizes.max() < least:
        return none, none, none
    # a value of its own before the first row and after every row
    text = np.empty(len(units) + len(rows), np.int64)
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    walls = rows + np.arange(len(rows))
    text[walls] = int(units.max()) + 1 + np.arange(len(rows))
    text[np.arange(len(units)) + row_of + 1] = units
    after, before = CommonExtensions(text), CommonExtensions(text[::-1].copy())
    last = len(text) - 1
    periods = np.where(sizes >= least, sizes // power, 0)
    row = np.repeat(np.arange(len(sizes)), periods)
    period = ranges(np.ones(len(sizes), np.int64), periods)
    stride = (power - 1) * period
    points = (sizes[row] - 1 - period) // stride + 1
    block = np.cumsum(points) // BLOCK
    found = []
    for lo, hi in _slices(block):
        count = points[lo:hi]
        pair = np.repeat(np.arange(lo, hi), count)
        i = walls[row[pair]] + 1 + stride[pair] * ranges(np.zeros(hi - lo, np.int64), count)
        q = period[pair]
        equal = text[i] == text[i + q]
        i, q = i[equal], q[equal]
        end = i + q + after(i, i + q)
        start = i - before(last - (i - 1), last - (i + q - 1))
        good = end - start >= np.maximum(least, power * q)
        found.append(_smallest_periods(start[good], end[good], q[good]))
    start, end, q = _smallest_periods(*(np.concatenate(x) for x in zip(*found, strict=True)))
    order = np.lexsort((q, start))
    start, end, q = start[order], end[order], q[order]
    shift = np.searchsorted(walls, start)
    return start - shift, end - shift, q


def _slices(block: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(block)) + 1
    yield from zip([0, *cuts], [*cuts, len(block)], strict=True)


def _smallest_periods(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once: found with several periods, they are multiples of the smallest."""
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], q[new]


def _rewritten(numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which word stands at each place: in rows whose number is a multiple of ten, words repeat from some place on."""
    source = np.arange(int(rows[-1]), dtype=np.int64)
    sizes = np.diff(rows)
    for r in np.flatnonzero((numbers >= 0) & (numbers % 10 == 0) & (sizes > 0)):
        n, g = int(sizes[r]), int(numbers[r]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[rows[r] + a : rows[r + 1]] = rows[r] + a + np.arange(n - a) % p
    return source


def collapse_runs(docs: DataFrame, id_name: str = "doc_id", text: str = "text", rewrite: Column | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, runs, collapsed), one row per document.

    ``runs`` lists all runs as structs of start, length and period; ``collapsed`` is the text without the words that a
    run repeats, joined by one blank; start, length and period are those of the longest run. ``rewrite``, a whole
    number per row, makes words repeat before runs are looked for where it is a multiple of ten.
    """
    given = docs.select(
        F.col(id_name).alias("id"), (F.lit(-1) if rewrite is None else rewrite).cast("long").alias("number"), text_or_empty(text).alias("text")
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000):
            data, offsets = text_bytes(batch.column(2))
            begins, ends, rows = find_words(data, offsets)
            source = _rewritten(batch.column(1).to_numpy(), rows)
            numbers = word_numbers(data, begins, ends)[source] if len(begins) else source
            start, stop, q = find_runs(numbers, rows)
            cover = np.zeros(len(source) + 1, np.int64)
            np.add.at(cover, start + q, 1)
            np.add.at(cover, stop, -1)
            stays = np.cumsum(cover[:-1]) == 0
            kept = source[stays]
            sizes = ends[kept] - begins[kept] + 1
            packed = data[np.minimum(ranges(begins[kept], sizes), max(len(data) - 1, 0))]
            packed[np.cumsum(sizes) - 1] = 32
            edges = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(stays)])[rows]]
            texts = [packed[a : max(a, b - 1)].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            owner = np.searchsorted(rows, start, side="right") - 1
            many = np.bincount(owner, minlength=len(rows) - 1)
            local = start - rows[owner]
            lead = np.lexsort((q, local, start - stop, owner))  # the first of each row is its longest
            best = np.full(len(many), -1)
            best[many > 0] = lead[(np.cumsum(many) - many)[many > 0]]
            has = best >= 0
            top = lambda values: pa.array(np.where(has, values[best] if len(values) else 0, 0), pa.int64(), mask=~has)  # noqa: E731, B023
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (local, stop - start, q)], fields=list(kind.value_type)),
            )
            yield pa.record_batch(
                [batch.column(0), pa.array(many.astype(np.int64)), top(local), top(stop - start), top(q), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"],
            )

    id_kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(
        run,
        f"doc_id {id_kind}, n_runs long, start long, length long, period long, "
        "runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )


def run_lines(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat_ws("", F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))))
