"""Language-model scores by a hierarchical Pitman-Yor process.

Every context has a restaurant: its customers are the training tokens that follow the context, its tables serve words,
and each table sends one customer to the parent restaurant that all contexts share. A context is the word before a
token (or the start of a text), told apart by its 64-bit hash. The base measure of the parent is diffuse: each new
table of the parent is a new word, so the probability of *some word never seen* is the parent's new-table probability,
and the probabilities of all known words and of the unknown one sum to 1.

Seating is sampled by Gibbs sweeps. A step takes all c customers of a word out of a restaurant, with what their tables
sent to the parent, and seats them again given everyone else. The number t of their tables has the probability

    p(t)  ~  S(c, t) * prod over k = 1 .. t - 1 of (theta + d (T + k)) (n + k - d0) / (theta0 + N + k)

with the tables T of the restaurant's other words, the other customers n of the word in the parent and N of the parent,
and S the generalised Stirling numbers (all seatings of c customers at t tables); t is drawn from it. The sizes
of the tables are summed out, as nothing else depends on them. All steps of a sweep see the state that the sweep before
left, as in other distributed samplers; on a toy corpus the mean numbers of tables are those of a sampler that moves
single customers one after the other. Up to ``LISTED`` customers S comes from its recurrence; beyond it is computed
where it matters, by a series, or by a saddle point where the series loses digits (within 1 percent). After the burn-in
sweeps the predictive probabilities of the kept sweeps are averaged; the score of a text is the sum of their logarithms.
The random number of a step depends on its word, context and sweep alone, so scores do not depend on partitions.

How it runs. Documents are packed into chunks: their words as numbers, and the distinct (word, context) cells with
counts. The words of all chunks meet by the upper bits of their hashes and get short names there; names instead of
hashes are what later steps store. Cells go to the bucket of their word, so all that a word needs but the totals per
context is in one place, whatever the word's frequency. The number of buckets follows the number of tokens. A bucket's
share of the totals of its contexts goes to the part of the context, one number per bucket and context, and the sums
come back to the buckets that asked. A cell with one customer has one table in every sweep, so sweeps only read and
send the cells with more (``alone`` has what the others add to their words); the last one answers for all contexts. A
bucket replays its sweeps, so a lost executor changes nothing; only the answers are stored between the sweeps. Finally
chunks ask buckets for their cells. What is shuffled are cells, not tokens: a word is one row per chunk and context,
however often it occurs.

Defined cases: a null text is empty, and an empty text is the one token that ends it. A null id counts as empty text
in the choice of training documents. Without training documents every score is 0. Words are told apart by 64-bit
hashes. Repeated rows are scored each. A very long text is part of one chunk. Extra columns are not looked at. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

from .arrays import LOWER, find_words, mix, pieces, ranges, text_bytes, word_hashes
from .columns import text_or_empty

#: Sweeps, and how many of them at the end are averaged.
SWEEPS, KEPT = 4, 2
CONCENTRATION = 1.0
#: Tokens per chunk, and per bucket on average.
CHUNK_TOKENS = 1_200_000
BUCKET_TOKENS = 1_000_000
#: Customers of a cell up to which the Stirling numbers are listed.
LISTED = 1024
END = mix(np.array([1], np.uint64))[0]
#: The context of a text's first token, before all others.
START = np.uint64(0)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of the same significance; the upper ones are mostly zero."""
    planes = np.ascontiguousarray(numbers.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(numbers) else b""


def _from_planes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, "<u4")
    planes = pa.decompress(data[8:], 4 * int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _longs(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed in the same way."""
    planes = np.ascontiguousarray(numbers.astype("<i8", copy=False).reshape(-1).view(np.uint8).reshape(-1, 8).T)
    return numbers.size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if numbers.size else b""


def _from_longs(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    planes = pa.decompress(data[8:], 8 * int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _sorted(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit names, as differences."""
    return _longs(np.diff(numbers, prepend=numbers.dtype.type(0)).view(np.int64))


def _from_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_from_longs(data).view(np.uint64), dtype=np.uint64)


def _pairs(word: np.ndarray, context: np.ndarray, contexts: int) -> tuple[bytes, bytes]:
    """Distinct (word, context) pairs as the number of words of each context, and the words one context after the other."""
    size = int(word.max()) + 1 if len(word) else 1
    return _planes(np.bincount(context, minlength=contexts)), _planes(np.sort(context * size + word) % size)


def _from_pairs(per_context: bytes, words: bytes, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word and context of each pair, by word and context; with ``order``, words were stored as places in it."""
    per, word = _from_planes(per_context), _from_planes(words).astype(np.int64)
    word = word if order is None else order[word]
    return np.divmod(np.sort(word * len(per) + np.repeat(np.arange(len(per)), per)), max(len(per), 1))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash of every token, whether it begins a row, and the n + 1 token offsets of the rows."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets)
    n = len(rows) - 1
    bounds = rows + np.arange(n + 1)  # one end token after the words of each row
    tokens = np.empty(bounds[-1], np.uint64)
    tokens[ranges(bounds[:-1], np.diff(rows))] = word_hashes(data, starts, ends)
    tokens[bounds[1:] - 1] = END
    begins = np.zeros(len(tokens), bool)
    begins[bounds[:-1]] = True
    return tokens, begins, bounds


CHUNK_SCHEMA = (
    "chunk long, ids array<long>, held array<boolean>, sizes array<int>, n_tokens long, often binary, tokens binary, "
    "words binary, cells binary, contexts binary, counts binary"
)
_CHUNK = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]


def _cells_of(which: np.ndarray, begins: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, as word number * (words + 1) + context, and the cell number of every token.

    A context is 0 at the start of a text, otherwise the number of the word before and 1.
    """
    context = np.zeros(len(which), np.int64)
    context[1:] = which[:-1] + 1
    context[begins] = 0
    return np.unique(which * (words + 1) + context, return_inverse=True)


def _by_frequency(often: np.ndarray) -> np.ndarray:
    """Words by falling frequency; what is stored for words is the place in this order."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _packed(chunk_tokens: int):
    """Chunks: documents, words by falling frequency as numbers, and the cells by word and context."""

    def finish(number: int, parts: list) -> pa.RecordBatch:
        tokens, begins, train = (np.concatenate([p[k] for p in parts]) for k in range(3))
        words, which = np.unique(tokens, return_inverse=True)
        parts[:] = [p[3:] for p in parts]
        del tokens
        often = np.bincount(which)
        place = np.empty(len(words), np.int64)
        place[_by_frequency(often)] = np.arange(len(words))
        numbers = _planes(place[which])
        cells, index = _cells_of(which, begins, len(words))
        counts = np.bincount(index, weights=train, minlength=len(cells))
        word_of, context_of = np.divmod(cells, len(words) + 1)
        row = (number, np.concatenate([p[0] for p in parts]).tolist(), np.concatenate([p[1] for p in parts]).tolist(),
               np.concatenate([p[2] for p in parts]).tolist(), len(which), _planes(often), numbers, _sorted(words),
               *_pairs(place[word_of], context_of, len(words) + 1), _planes(counts))
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 6]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in pieces(batches, "text"):
            tokens, begins, bounds = tokens_of(batch.column(2))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            sizes = np.diff(bounds)
            parts.append((tokens, begins, np.repeat(~held, sizes), np.array(batch.column(0).to_pylist(), object), held, sizes))
            size += len(tokens)
            if size >= chunk_tokens:
                yield finish(number, parts)
                number, parts, size = number + 1, [], 0
        if parts:
            yield finish(number, parts)

    return run


def _parts_of(names: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The parts of ascending hashes or names, which are their upper bits."""
    edge = np.append(np.flatnonzero(np.diff(names >> np.uint64(64 - bits), prepend=np.uint64(2**63))), len(names))
    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(names[a] >> np.uint64(64 - bits)), slice(a, z)


SPELLED_SCHEMA = "chunk long, part int, words binary"


def _spelled(bits: int):
    """The hashes of a chunk's words and of the start, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(*batch.to_pydict().values(), strict=True):
                hashes = np.unique(np.append(START, _from_sorted(words)))
                parts, own = zip(*_parts_of(hashes, bits), strict=True)
                types = [pa.int64(), pa.int32(), pa.binary()]
                data = [[chunk] * len(parts), list(parts), [_sorted(hashes[x]) for x in own]]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(data, types, strict=True)], ["chunk", "part", "words"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each hash among all of its part, for the chunks that asked; rows come in the order of parts."""

    def reply(part: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        asked = [_from_sorted(w) for _, w in rows]
        known = np.unique(np.concatenate(asked))
        data = [[c for c, _ in rows], [part] * len(rows), [_sorted(np.searchsorted(known, a).astype(np.uint64)) for a in asked]]
        return pa.record_batch([pa.array(x, t) for x, t in zip(data, [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["chunk", "part", "words"])

    part, rows = None, []
    for batch in batches:
        for chunk, own, words in zip(*batch.to_pydict().values(), strict=True):
            if own != part and rows:
                yield reply(part, rows)
                rows = []
            part = own
            rows.append((chunk, words))
    if rows:
        yield reply(part, rows)


LIST_SCHEMA = "chunk long, bucket int, words binary, cells binary, contexts binary, counts binary, names binary"


def _listed(bits: int):
    """A chunk's cells by bucket of the word, from its cells (part -1) and the names of its words by part."""

    def finish(chunk: int, data: tuple, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        names = np.concatenate([(np.uint64(p) << np.uint64(64 - bits)) | _from_sorted(x) for p, x in found])
        words, often, counts = names[1:], _from_planes(data[0]), _from_planes(data[3])
        word_of, context_of = _from_pairs(data[1], data[2], _by_frequency(often))
        ends = np.searchsorted(word_of, np.arange(len(words) + 1))
        rows = []
        for b, w in _parts_of(words, bits):
            c = slice(ends[w.start], ends[w.stop])
            own, at = np.unique(context_of[c], return_inverse=True)
            rows.append((chunk, b, _sorted(words[w]), *_pairs(word_of[c] - w.start, at, len(own)), _planes(counts[c]), _sorted(names[own])))
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in LIST_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, data, found = None, None, []
        for batch in batches:
            for own, part, words, *cells in zip(*batch.to_pydict().values(), strict=True):
                if part < 0:
                    if found:
                        yield finish(chunk, data, found)
                    chunk, data, found = own, cells, []
                else:
                    found.append((part, words))
        if found:
            yield finish(chunk, data, found)

    return run


class Cells(NamedTuple):
    """Training counts of a bucket: sorted words, and for each (word, context) cell its word, context and count.

    ``names`` has the sorted names of the contexts; ``alone`` what cells that are left out add to each word's tables.
    """

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    names: np.ndarray
    alone: np.ndarray | None = None

    @property
    def key(self) -> np.ndarray:
        return self.word * len(self.names) + self.context

    def at_parent(self, tables: np.ndarray) -> np.ndarray:
        found = np.bincount(self.word, weights=tables, minlength=len(self.words))
        return found if self.alone is None else found + self.alone

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.names)).astype(np.int64)


def _unpack(words: bytes, cells: bytes, contexts: bytes, counts: bytes, names: bytes) -> Cells:
    return Cells(_from_sorted(words), *_from_pairs(cells, contexts), _from_planes(counts).astype(np.int64), _from_sorted(names))


def _merge(parts: list[Cells]) -> Cells:
    words, names = (np.unique(np.concatenate([p[k] for p in parts])) for k in (0, 4))
    key = np.concatenate([np.searchsorted(words, p.words)[p.word] * len(names) + np.searchsorted(names, p.names)[p.context] for p in parts])
    cells, index = np.unique(key, return_inverse=True)
    word, context = np.divmod(cells, max(len(names), 1))
    return Cells(words, word, context, np.bincount(index, weights=np.concatenate([p.count for p in parts]), minlength=len(cells)).astype(np.int64), names)


def several(cells: Cells) -> Cells:
    """The cells with more than one customer, their words and contexts; the rest is in ``alone``."""
    chosen = cells.count > 1
    words, word = np.unique(cells.word[chosen], return_inverse=True)
    names, context = np.unique(cells.context[chosen], return_inverse=True)
    alone = np.bincount(cells.word[cells.count == 1], minlength=len(cells.words))[words]
    return Cells(cells.words[words], word, context, cells.count[chosen], cells.names[names], alone)


CELLS_SCHEMA = "bucket int, several boolean, words binary, cells binary, contexts binary, counts binary, names binary, alone binary"
_CELLS = [x.split()[0] for x in CELLS_SCHEMA.split(", ")]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per bucket, all cells and those of ``several``, from rows in bucket order. Chunks are merged a few at a time."""

    def row(bucket: int, part: bool, c: Cells) -> pa.RecordBatch:
        alone = np.zeros(0, np.int64) if c.alone is None else c.alone
        data = (_sorted(c.words), *_pairs(c.word, c.context, len(c.names)), _longs(c.count), _sorted(c.names), _longs(alone))
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([part]), *(pa.array([x], pa.binary()) for x in data)], _CELLS)

    def rows(bucket: int, parts: list[Cells]) -> Iterator[pa.RecordBatch]:
        c = _merge(parts)
        yield row(bucket, False, c)
        yield row(bucket, True, several(c))

    bucket, parts = None, []
    for batch in batches:
        columns = batch.to_pydict()
        for b, *data in zip(*(columns[k] for k in ("bucket", "words", "cells", "contexts", "counts", "names")), strict=True):
            if b != bucket and parts:
                yield from rows(bucket, parts)
                parts = []
            bucket = b
            parts.append(_unpack(*data))
            if len(parts) >= 16:
                parts = [_merge(parts)]
    if parts:
        yield from rows(bucket, parts)


def _stored(words: bytes, cells: bytes, contexts: bytes, counts: bytes, names: bytes, alone: bytes) -> Cells:
    return Cells(_from_sorted(words), *_from_pairs(cells, contexts), _from_longs(counts), _from_sorted(names), _from_longs(alone) if alone else None)


class Model(NamedTuple):
    """Totals of the training tokens and, for every sweep so far, the tables per context.

    Where the vectors per context only have the contexts of a bucket, ``totals`` has the tables of all contexts together.
    """

    tokens: int
    words: int
    customers: np.ndarray
    discount: float
    parent_discount: float
    tables: tuple[np.ndarray, ...]
    totals: tuple[int, ...] = ()

    def all_tables(self, sweep: int) -> int:
        return self.totals[sweep] if self.totals else self.tables[sweep].sum()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    z = x + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


_STIRLING: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the seatings of c customers at t tables, for c and t up to ``LISTED``; minus infinity where there are none."""
    if discount not in _STIRLING:
        _STIRLING.clear()
        table = np.full((LISTED + 1, LISTED + 1), -np.inf)
        table[1, 1] = 0
        t = np.arange(1, LISTED + 1)
        for c in range(1, LISTED):
            table[c + 1, 1 : c + 2] = np.logaddexp(table[c, : c + 1], table[c, 1 : c + 2] + np.log(np.maximum(c - discount * t[: c + 1], 1e-300)))
        _STIRLING[discount] = table
    return _STIRLING[discount]


def log_stirling_at(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """The same for pairs of many customers and a number of tables, but for a constant of each c.

    The number is c! / t! d^-t times the coefficient of x^c in (1 - (1 - x)^d)^t, whose binomial expansion is a short
    alternating series while t is small beside c^d. Where it cancels, the coefficient is taken at its saddle point.
    """
    d, t = discount, t.astype(float)
    values, which = np.unique(c, return_inverse=True)
    values = values.astype(float)
    logs = np.log(values)
    near = np.flatnonzero(t < 40 * (values**d)[which])  # beyond, the series surely cancels
    of, few, shrink = which[near], t[near], (values**-d)[which[near]]
    total, most, choose, last = np.zeros(len(near)), np.zeros(len(near)), np.ones(len(near)), np.full(len(near), np.inf)
    by_series = np.full(len(t), np.nan)
    with np.errstate(all="ignore"):
        first = _lgamma(values)
        for k in range(1, 120 if len(near) else 0):
            choose *= np.maximum(few - k + 1, 0) / k * shrink
            rest = np.maximum(values - d * k, 1e-9)
            scale = (np.exp(np.minimum(_lgamma(rest) - first + d * k * logs + math.lgamma(d * k + 1), 600)) / math.pi)[of]
            last = choose * scale
            total += last * ((-1) ** (k + 1) * math.sin(math.pi * d * k))
            most = np.maximum(most, last)
            if ((last <= 1e-12 * total) | (most > 1e8 * np.abs(total))).all():
                break
        fine = np.zeros(len(t), bool)
        fine[near] = (total > 1e-7 * most) & (last <= 1e-9 * total)
        by_series[near] = np.log(total) - logs[of]
        wanted, low, high = np.log(c / t), np.full(len(t), -200.0), np.full(len(t), -1e-12)
        for step in range(18):
            s = (low + high) / 2 if step < 12 else np.clip(s - gap / slope, low, high)
            y, power = np.exp(s), -np.expm1(d * s)
            gap = math.log(d) + np.log1p(-y) + (d - 1) * s - np.log(power) - wanted
            low, high = np.where(gap > 0, s, low), np.where(gap > 0, high, s)
            slope = -y / (1 - y) + (d - 1) + d * (1 - power) / power
        spread = c / t * np.maximum(-slope * (1 - y) / y, 1e-12)
        by_saddle = t * np.log(power) - c * np.log1p(-y) - 0.5 * np.log(2 * np.pi * t * spread)
    # no step where one gives way to the other
    order = np.lexsort((np.where(fine, t, -1), which))
    ends = order[np.searchsorted(which[order], np.arange(len(values)), "right") - 1]
    by_saddle += np.where(fine[ends], by_series[ends] - by_saddle[ends], 0)[which]
    return np.where(fine, by_series, by_saddle) - _lgamma(t + 1) - t * math.log(d)


class Others(NamedTuple):
    """What a step sees of everyone else, per cell: tables of the restaurant, customers of the word in the parent, all of the parent."""

    tables: np.ndarray
    customers: np.ndarray
    parent: np.ndarray


def _tables_of_many(count: np.ndarray, others: Others, discount: float, parent_discount: float, chance: np.ndarray) -> np.ndarray:
    """Tables of cells with many customers, drawn among all numbers that weigh more than e^-35 of the likeliest."""

    def weights(cell: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (
            log_stirling_at(count[cell], t, discount) + (t - 1) * math.log(discount) + _lgamma(CONCENTRATION / discount + others.tables[cell] + t)
            + _lgamma(others.customers[cell] + t - parent_discount) - _lgamma(CONCENTRATION + others.parent[cell] + t)
        )

    n, points = len(count), 33
    low, high, rows = np.ones(n, np.int64), count.astype(np.int64), np.arange(n)
    for _ in range(16):
        t = low[:, None] + ((high - low)[:, None] * np.linspace(0, 1, points)).astype(np.int64)
        logs = weights(np.repeat(rows, points), t.ravel()).reshape(n, points)
        near = logs > logs.max(axis=1, keepdims=True) - 35
        width = high - low
        low, high = t[rows, np.maximum(near.argmax(axis=1) - 1, 0)], t[rows, np.minimum(points - near[:, ::-1].argmax(axis=1), points - 1)]
        if (high - low >= width * 3 // 4).all():
            break
    sizes = high - low + 1
    cell, t = np.repeat(rows, sizes), ranges(low, sizes)
    logs = weights(cell, t)
    begins = np.cumsum(sizes) - sizes
    chances = np.exp(logs - np.maximum.reduceat(logs, begins)[cell])
    total = np.cumsum(chances)
    before = total[begins] - chances[begins]
    at = np.searchsorted(total, before + chance * (total[begins + sizes - 1] - before))
    return t[np.clip(at, begins, begins + sizes - 1)]


def reseat(count: np.ndarray, others: Others, discount: float, parent_discount: float, chance: np.ndarray) -> np.ndarray:
    """Tables of each cell after all its ``count`` customers left and came back; ``chance`` has a uniform number for each."""
    tables = (count > 0).astype(np.int64)
    listed = log_stirling(discount)
    order = np.argsort(count, kind="stable")
    order = order[np.searchsorted(count[order], 2) :]
    many = np.searchsorted(count[order], LISTED + 1)
    start = 0
    while start < many:
        # cells of about the same count are rows of one matrix
        most = min(LISTED, max(int(count[order[start]]) * 5 // 4, 2))
        end = min(many, int(np.searchsorted(count[order], most + 1)), start + max(1, 1_000_000 // most))
        rows = order[start:end]
        most = int(count[rows[-1]])
        k = np.arange(1, most)
        steps = np.log(
            (CONCENTRATION + discount * (others.tables[rows, None] + k)) * (others.customers[rows, None] + k - parent_discount) / (CONCENTRATION + others.parent[rows, None] + k)
        )
        logs = listed[count[rows], 1 : most + 1]
        logs[:, 1:] += np.cumsum(steps, axis=1)
        total = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        tables[rows] = 1 + (total < chance[rows, None] * total[:, -1:]).sum(axis=1)
        start = end
    for start in range(many, len(order), 128):
        rows = order[start : start + 128]
        tables[rows] = _tables_of_many(count[rows], Others(*(x[rows] for x in others)), discount, parent_discount, chance[rows])
    return tables


def _chances(cells: Cells, sweep: int) -> np.ndarray:
    """A uniform number for each cell of a sweep, whichever other cells are beside it."""
    spread = mix(cells.names * np.uint64(0x9E3779B97F4A7C15) + np.uint64(sweep + 1))
    return (mix(mix(cells.words)[cells.word] + spread[cells.context]) >> np.uint64(11)) * 2.0**-53


def seatings(cells: Cells, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of every cell and customers of every word in the parent: at first, then after each sweep known so far and one more."""
    tables = (cells.count > 0).astype(np.int64)
    for sweep, known in enumerate(model.tables):
        at_parent = cells.at_parent(tables)
        yield tables, at_parent
        others = Others(known[cells.context] - tables, at_parent[cells.word] - tables, model.all_tables(sweep) - tables)
        tables = reseat(cells.count, others, model.discount, model.parent_discount, _chances(cells, sweep))
    yield tables, cells.at_parent(tables)


def predictive(cells: Cells, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the averaged probability of every cell, and the training count of every word."""
    kept = min(KEPT, len(model.tables))
    total = np.zeros(len(cells.word))
    states = list(seatings(cells, model))[: len(model.tables)][-kept:]
    for sweep, (tables, at_parent) in enumerate(states, len(model.tables) - kept):
        known, all_tables = model.tables[sweep], CONCENTRATION + model.all_tables(sweep)
        unseen = (CONCENTRATION + model.parent_discount * model.words) / all_tables
        p = np.where(at_parent > 0, (at_parent - model.parent_discount) / all_tables, unseen)
        back = (CONCENTRATION + model.discount * known) / (CONCENTRATION + model.customers)
        own = np.maximum(cells.count - model.discount * tables, 0) / (CONCENTRATION + model.customers)[cells.context]
        total += own + back[cells.context] * p[cells.word]
    return np.log10(total / kept), np.bincount(cells.word, weights=cells.count, minlength=len(cells.words)).astype(np.int64)


#: Rows of the totals per context: values are a list of vectors over the contexts that were asked for, one after the other.
TOTALS_SCHEMA = "bucket int, several boolean, round int, part int, names binary, values binary, total long"
_TOTALS = [x.split()[0] for x in TOTALS_SCHEMA.split(", ")]


def _request(bucket: int, several: bool, number: int, bits: int, names: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch | None:
    """A bucket's share of the totals of its contexts, for each part of them; a part is the upper bits of a name."""
    rows = [(bucket, several, number, part, _sorted(names[own]), _longs(np.concatenate([v[own] for v in values])), None) for part, own in _parts_of(names, bits)]
    return _totals_batch(rows) if rows else None


def _totals_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], _TOTALS)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per context for all buckets that asked, from rows in the order of parts; a row with bucket -1 has the sum of the last vector."""

    def reply(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        asked = [_from_sorted(r[4]) for r in rows]
        given = [_from_longs(r[5]).reshape(-1, len(x)) for r, x in zip(rows, asked, strict=True)]
        names, index = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.zeros((len(given[0]), len(names)), np.int64)
        for k, own in enumerate(sums):
            np.add.at(own, index, np.concatenate([g[k] for g in given]))
        yield _totals_batch([(-1, False, rows[0][2], rows[0][3], None, None, int(sums[-1].sum()))])
        at = np.split(index, np.cumsum([len(x) for x in asked])[:-1])
        for k in range(0, len(rows), 256):
            yield _totals_batch([(*r[:4], None, _longs(sums[:, i]), None) for r, i in zip(rows[k : k + 256], at[k : k + 256], strict=True)])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*batch.to_pydict().values(), strict=True):
            if held and held[0][3] != row[3]:
                yield from reply(held)
                held = []
            held.append(row)
    if held:
        yield from reply(held)


def _first_totals(bits: int):
    """Requests for customers and cells per context. Rows of ``several`` only ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, *data in zip(*batch.to_pydict().values(), strict=True):
                c = _stored(*data)
                shares = [c.per_context(x) * (not part) for x in (c.count, c.count > 0)]
                if (request := _request(bucket, part, 0, bits, c.names, shares)) is not None:
                    yield request

    return run


def _of_bucket(cells: Cells, model: Model, answers: dict[int, list], sweeps: int) -> Model:
    """The model for the contexts of ``cells``, from the answers to its bucket by round, each in the order of parts."""

    def vectors(number: int) -> np.ndarray:
        found = [_from_longs(values).reshape(many, -1) for many, values in answers[number]]
        return np.concatenate(found, axis=1)

    if not len(cells.names):
        return model._replace(customers=np.zeros(0, np.int64), tables=tuple(np.zeros(0, np.int64) for _ in model.totals))
    customers, first = vectors(0)
    tables = [first]
    # answers of the rounds before the last are for the contexts of cells with several customers; no other cell depends on them
    active = np.unique(cells.context[cells.count > 1])
    for number in range(1, len(model.totals)):
        known = first.copy()
        if number < sweeps and number in answers:
            known[active] += vectors(number)[0]
        tables.append(known)
    if sweeps in answers and sweeps > 0:
        last = vectors(sweeps)
        for k, extra in enumerate(last[::-1]):
            tables[-1 - k] = first + extra
    return model._replace(customers=customers, tables=tuple(tables))


def _many(number: int, sweeps: int) -> int:
    """Vectors in the answers of a round."""
    return 2 if number == 0 else min(KEPT, sweeps + 1) if number == sweeps else 1


def _sweep(shared, number: int, sweeps: int, bits: int):
    """From buckets (cells, then the answers to them) to requests for the tables beyond the first of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, cells, part, answers = None, None, None, {}

        def request() -> pa.RecordBatch | None:
            if not len(cells.names):
                return None
            states = [t for t, _ in seatings(cells, _of_bucket(cells, shared.value, answers, sweeps))]
            extra = [cells.per_context(np.maximum(t - 1, 0)) for t in states[-_many(number, sweeps) :]]
            return _request(bucket, part, number, bits, cells.names, extra)

        for batch in batches:
            for b, r, own, values, *data in zip(*batch.to_pydict().values(), strict=True):
                if r < 0:
                    if cells is not None and (made := request()) is not None:
                        yield made
                    bucket, cells, part, answers = b, _stored(*data), own, {}
                else:
                    answers.setdefault(r, []).append((_many(r, sweeps), values))
        if cells is not None and (made := request()) is not None:
            yield made

    return run


def _with_answers(cells: DataFrame, answers: list[DataFrame], part: bool) -> DataFrame:
    """(bucket, round, part, several, values, cells ...): the cells of every bucket and the answers to it."""
    data = _CELLS[2:]
    head = cells.where(F.col("several") == part).select(
        "bucket", F.lit(-1).alias("round"), F.lit(-1).alias("part"), "several", F.lit(None).cast("binary").alias("values"), *data
    )
    for number, found in enumerate(answers):
        # the rounds between the first and the last answer cells of several customers; all cells replay them too
        own = F.col("several") == part if number == 0 else F.lit(True)
        head = head.union(found.where((F.col("bucket") >= 0) & own).select("bucket", "round", "part", "several", "values", *(F.lit(None).cast("binary").alias(k) for k in data)))
    return head


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens; words; words of one and two tables at first; cells of one and two customers."""
    sums = np.zeros(6, np.int64)
    for batch in batches:
        for _, _, *data in zip(*batch.to_pydict().values(), strict=True):
            c = _stored(*data)
            at_parent = np.bincount(c.word[c.count > 0], minlength=len(c.words))
            sums += [c.count.sum(), (at_parent > 0).sum(), (at_parent == 1).sum(), (at_parent == 2).sum(), (c.count == 1).sum(), (c.count == 2).sum()]
    yield pa.record_batch([pa.array(range(6), pa.int32()), pa.array(sums)], ["key", "value"])


def fit(cells: DataFrame, bits: int, sweeps: int = SWEEPS) -> tuple[Model, list[DataFrame]]:
    """Totals of all tokens, and the answers of all rounds. The driver sees one number per sweep, never cells or contexts."""
    spark = cells.sparkSession
    found = cells.where("NOT several").mapInArrow(_word_totals, "key int, value long").groupBy("key").agg(F.sum("value").alias("value")).collect()
    n, words, *rest = (dict.fromkeys(range(6), 0) | {r["key"]: r["value"] for r in found}).values()
    share = lambda once, twice: min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    def meet(requests: DataFrame, number: int) -> tuple[DataFrame, int]:
        by_part = requests.repartition("part").sortWithinPartitions("part", "bucket", "several")
        stored = cut_lineage(by_part.mapInArrow(_met, TOTALS_SCHEMA), f"lm-totals-{number}")
        return stored, stored.where("bucket < 0").agg(F.sum("total")).first()[0] or 0

    first, tables = meet(cells.mapInArrow(_first_totals(bits), TOTALS_SCHEMA), 0)
    model = Model(n, words, np.zeros(0, np.int64), share(*rest[2:]), share(*rest[:2]), (), (tables,))
    answers = [first]
    for number in range(1, sweeps + 1):
        shared = spark.sparkContext.broadcast(model)
        given = _with_answers(cells, answers, number < sweeps)
        ordered = given.repartition("bucket").sortWithinPartitions("bucket", "round", "part").select("bucket", "round", "several", "values", *_CELLS[2:])
        replies, extra = meet(ordered.mapInArrow(_sweep(shared, number, sweeps, bits), TOTALS_SCHEMA), number)
        answers.append(replies)
        model = model._replace(totals=(*model.totals, tables + extra))
    return model, answers


def _answered(shared, sweeps: int):
    """For the cells of each chunk, probabilities from the bucket's model, which comes first in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_bucket, cells, key, scores, counts, answers = None, None, None, None, None, {}
        for batch in batches:
            columns = batch.to_pydict()
            out = []
            for bucket, number, chunk, values, *data in zip(*columns.values(), strict=True):
                if chunk is None and number < 0:
                    cells, model_bucket, scores, answers = _stored(*data), bucket, None, {}
                    continue
                assert bucket == model_bucket
                if chunk is None:
                    answers.setdefault(number, []).append((_many(number, sweeps), values))
                    continue
                if scores is None:
                    key = cells.key
                    scores, counts = predictive(cells, _of_bucket(cells, shared.value, answers, sweeps))
                asked = _unpack(*data[:-1])
                at = np.searchsorted(cells.words, asked.words)
                place = np.searchsorted(key, at[asked.word] * len(cells.names) + np.searchsorted(cells.names, asked.names)[asked.context])
                per_cell = np.bincount(asked.word, minlength=len(asked.words))
                out.append((chunk, bucket, _planes(scores[place].astype(np.float32).view("<u4")), _planes(per_cell), pa.compress(counts[at].tobytes(), "zstd", asbytes=True)))
            if out:
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["chunk", "bucket", "scores", "cells", "counts"])

    return run


def _summed(tokens: int, words: int):
    """Document rows from a chunk (first) and the answers to its cells in bucket order."""

    def finish(ids, held, sizes, often, numbers, answers) -> pa.RecordBatch:
        scores = np.concatenate([_from_planes(a[0]).view(np.float32) for a in answers]).astype(np.float64)
        per_word = [_from_planes(a[1]) for a in answers]
        words_seen = [np.frombuffer(pa.decompress(a[2], 8 * len(n), "zstd", asbytes=True), np.int64) for a, n in zip(answers, per_word, strict=True)]
        counts = np.concatenate([np.repeat(c, n) for c, n in zip(words_seen, per_word, strict=True)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        by_frequency = _by_frequency(_from_planes(often))
        _, index = _cells_of(by_frequency[_from_planes(numbers)], bounds, len(by_frequency))
        count = counts[index]
        base = np.log10(count + 0.5) - np.log10(tokens + 0.5 * (words + 1))
        sums = [np.add.reduceat(x, bounds) for x in ((count > 0).astype(np.int64), base, scores[index])]
        n = len(ids)
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(held), pa.array(sizes, pa.int64()), pa.array(sums[0]), pa.array([tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, head, answers = None, None, []
        for batch in batches:
            columns = batch.to_pydict()
            for number, _, ids, held, sizes, often, numbers, *answer in zip(*columns.values(), strict=True):
                if number != chunk:
                    if answers:
                        yield finish(*head, answers)
                    chunk, head, answers = number, (ids, held, sizes, often, numbers), []
                else:
                    answers.append(answer)
        if answers:
            yield finish(*head, answers)

    return run


def score_documents(docs: DataFrame, held_out: Column, id_name: str = "doc_id", text: str = "text", sweeps: int = SWEEPS,
                    chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per document with its token counts, base score and model score; learns from rows that are not ``held_out``."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_name).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_or_empty(text).alias("text"))
    packed = cut_lineage(given.mapInArrow(_packed(chunk_tokens), CHUNK_SCHEMA), "lm-chunks")
    tokens = packed.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(1, min(20, (tokens // bucket_tokens).bit_length()))
    spelled = packed.select("chunk", "words").mapInArrow(_spelled(bits), SPELLED_SCHEMA)
    named = spelled.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(_named, SPELLED_SCHEMA)
    cells = ("often", "cells", "contexts", "counts")
    parts = packed.select("chunk", F.lit(-1).alias("part"), F.lit(None).cast("binary").alias("words"), *cells).union(
        named.select("*", *(F.lit(None).cast("binary").alias(k) for k in cells))
    )
    lists = cut_lineage(parts.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_listed(bits), LIST_SCHEMA), "lm-lists")
    by_bucket = lists.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    cells = cut_lineage(by_bucket.drop("chunk").mapInArrow(_merged, CELLS_SCHEMA), "lm-cells")
    model, totals = fit(cells, bits, sweeps)
    shared = spark.sparkContext.broadcast(model)
    absent = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = _with_answers(cells, totals, False).withColumn("chunk", absent("long", "chunk"))
    asked = lists.select("bucket", F.lit(sweeps + 1).alias("round"), F.lit(-1).alias("part"), absent("boolean", "several"), absent("binary", "values"),
                         "words", "cells", "contexts", "counts", "names", absent("binary", "alone"), "chunk")
    answers = (
        first.union(asked).repartition("bucket").sortWithinPartitions("bucket", "round", "part", "chunk")
        .select("bucket", "round", "chunk", "values", *_CELLS[2:])
        .mapInArrow(_answered(shared, sweeps), "chunk long, bucket int, scores binary, cells binary, counts binary")
    )
    nothing = [F.lit(None).cast("binary").alias(k) for k in ("scores", "cells", "counts")]
    kept = ("ids", "held", "sizes", "often", "tokens")
    heads = packed.select("chunk", F.lit(-1).alias("bucket"), *kept, *nothing)
    like = [F.lit(None).cast(heads.schema[k].dataType).alias(k) for k in kept]
    return (
        heads.union(answers.select("chunk", "bucket", *like, "scores", "cells", "counts"))
        .repartition("chunk")
        .sortWithinPartitions("chunk", "bucket")
        .mapInArrow(
            _summed(model.tokens, model.words),
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
