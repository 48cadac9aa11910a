"""Repeated windows of a fixed number of units (words or bytes) across all documents.

Consecutive windows that share their minimiser form one run, and equal windows always lie in runs with the same
minimiser. So only minimisers tell where repeats can be:

1. every run is described by minimiser, digest of its units and place, without its text;
2. an aggregate with map-side combine finds the minimisers of more than one run. Most runs end here;
3. where all runs of a minimiser are equal, every window of them repeats, and nothing has to be looked at;
4. the other minimisers are contested: of each distinct run one copy is cut from its document and travels as one
   packed string to the bucket of its minimiser, where a ``judge`` finds the equal windows;
   A minimiser of more than ``CROWD`` runs would fill a task: its distinct runs are taken apart into windows, which an
   aggregate by 128-bit digest counts wherever they are;
5. the findings go back from the distinct runs to all places by an equi-join on minimiser and digest; runs of step 3
   pass it unmatched.

A passage that a third of all documents hold is therefore one row after step 2 and one string in step 4; the joins in
steps 2 and 5 are plain equi-joins of narrow rows which adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

from .arrays import BASE, find_words, mix, pieces, prefix_hashes, ranges, span_hashes, super_kmers, text_bytes, window_hashes, word_hashes
from .columns import text_or_empty

#: Sorts after all ids; stands for a null id.
NO_ID = 2**63 - 1
#: Runs of a contested minimiser from which its windows are counted by digest instead of in one task.
CROWD = 10_000
#: Text that a bucket task works on at once.
BATCH_BYTES = 1_000_000


def keyed(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, hash, text): rows with the same id and text are copies of one row and share every finding.

    ``hash`` has 128 bits of the text, so unlike texts under one id, or without any, stay apart. Columns named in ``carry`` follow as c0, c1, and so on, so that no name can clash.
    """
    return docs.select(
        F.coalesce(F.col(id_name), F.lit(NO_ID)).cast("long").alias("id"),
        F.unhex(F.md5(text_or_empty(text_name).cast("binary"))).alias("hash"),
        text_or_empty(text_name).alias("text"),
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
    )


def real_id() -> Column:
    return F.when(F.col("id") != NO_ID, F.col("id"))


def _units(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    if unit == "byte":  # none of them is 0, which would leave no trace in a hash
        return data.astype(np.uint16) + 1, offsets
    starts, ends, rows = find_words(data, offsets)
    return word_hashes(data, starts, ends), rows


def _runs(unit: str, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            units, rows = _units(batch.column(2), unit)
            mini, body, start, windows = super_kmers(units, rows, width, gram)
            body = mix(body ^ (windows.astype(np.uint64) * BASE))  # the length is part of a run's digest
            row = np.searchsorted(rows, start, side="right") - 1
            yield pa.record_batch(
                [
                    pa.array(batch.column(0).to_numpy()[row]),
                    batch.column(1).take(pa.array(row)),
                    pa.array(mini.view(np.int64)),
                    pa.array(body.view(np.int64)),
                    pa.array((start - rows[row]).astype(np.int64)),
                    pa.array(windows.astype(np.int32)),
                ],
                ["id", "hash", "mini", "body", "start", "windows"],
            )

    return run


def _cut(unit: str, width: int):
    """From documents with the places of chosen runs to packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            data, offsets = text_bytes(batch.column(0))
            lists = batch.column(1)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            chosen = lists.flatten()
            field = lambda name: chosen.field(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            first, count = field("start"), field("windows") + width - 1
            if unit == "byte":
                begin = offsets[row] + first
                end = begin + count
            else:
                starts, ends, rows = find_words(data, offsets)
                begin = starts[rows[row] + first]
                end = ends[rows[row] + first + count - 1]
            packed = data[ranges(begin, end - begin)]
            if unit == "word":  # one blank between words, whatever stood there
                packed, sizes = _single_spaces(packed, end - begin)
            else:
                sizes = end - begin
            edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            strings = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(packed)])
            yield pa.record_batch(
                [pa.array(field(k)) for k in ("mini", "body", "copies", "first", "crowded")] + [strings.cast(pa.binary())],
                ["mini", "body", "copies", "first", "crowded", "packed"],
            )

    return run


def _single_spaces(packed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    starts, ends, rows = find_words(packed, edges)
    lengths = ends - starts + 1
    out = packed[np.minimum(ranges(starts, lengths), max(len(packed) - 1, 0))]
    out[np.cumsum(lengths) - 1] = 32
    return out, np.add.reduceat(lengths, rows[:-1]) if len(sizes) else sizes


def _taken_apart(unit: str, width: int):
    """One row per window of a run: two independent digests of its units and its place in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed", BATCH_BYTES // 4):
            units, rows = _units(batch.column(4), unit)
            if unit == "word":  # a second hash of each word, of its mixed bytes
                data, offsets = text_bytes(batch.column(4))
                starts, ends, _ = find_words(data, offsets)
                other = span_hashes(prefix_hashes(mix(data.astype(np.uint64) + np.uint64(257))), starts, ends)
            else:
                other = mix(units.astype(np.uint64) + np.uint64(257))
            windows = np.diff(rows) - width + 1
            at = ranges(rows[:-1], windows)
            row = np.repeat(np.arange(len(windows)), windows)
            field = lambda k: batch.column(k).to_numpy()[row]  # noqa: E731, B023
            digests = [window_hashes(prefix_hashes(x), width)[at].view(np.int64) for x in (units, other)]
            yield pa.record_batch(
                [*map(pa.array, digests), pa.array((at - rows[row]).astype(np.int64)), *(pa.array(field(k)) for k in range(4))],
                ["one", "two", "begin", "mini", "body", "copies", "first"],
            )

    return run


def _joined_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal ranges of a run's repeated windows with one smallest id; a run has fewer windows than two widths."""
    for batch in batches:
        lists = batch.column(2)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        begin, smallest = (lists.flatten().field(k).to_numpy() for k in ("begin", "smallest"))
        if not len(begin):
            continue
        new = np.ones(len(begin), bool)
        new[1:] = (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1) | (smallest[1:] != smallest[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(begin)) - 1
        yield pa.record_batch(
            [*(batch.column(k).take(pa.array(row[lo])) for k in (0, 1)), pa.array(begin[lo]), pa.array(begin[hi] + 1), pa.array(smallest[lo])],
            ["mini", "body", "begin", "end", "smallest"],
        )


def _counted(packed: DataFrame, unit: str, width: int) -> DataFrame:
    """Findings in the runs of crowded minimisers. No group of equal windows or runs is gathered; both joins are plain equi-joins."""
    windows = packed.select("mini", "body", "copies", "first", "packed").mapInArrow(
        _taken_apart(unit, width), "one long, two long, begin long, mini long, body long, copies long, first long"
    )
    several = windows.groupBy("one", "two").agg(F.sum("copies").alias("n"), F.min("first").alias("smallest")).where("n > 1")
    found = windows.join(several.select("one", "two", "smallest"), ["one", "two"])
    by_run = found.groupBy("mini", "body").agg(F.sort_array(F.collect_list(F.struct("begin", "smallest"))).alias("windows"))
    return by_run.mapInArrow(_joined_ranges, "mini long, body long, begin long, end long, smallest long")


def _judged(judge: Callable, width: int):
    """Whole minimisers at a time, several of them together up to a bounded size."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        number = lambda name: table[name].to_numpy()
        run, begin, end, first = judge(table["packed"].combine_chunks(), number("copies"), number("first"), width)
        return pa.record_batch(
            [*(pa.array(number(k)[run]) for k in ("mini", "body")), *(pa.array(x.astype(np.int64)) for x in (begin, end, first))],
            ["mini", "body", "begin", "end", "smallest"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            mini = batch.column(0).to_numpy()
            bytes_up_to = text_bytes(batch.column(4))[1]
            at = 0
            for cut in [*(np.flatnonzero(mini[1:] != mini[:-1]) + 1), batch.num_rows]:
                new_group = last is not None and mini[at] != last
                if new_group and size + bytes_up_to[cut] - bytes_up_to[at] > BATCH_BYTES and held:
                    yield flush(held)
                    held, size = [], 0
                held.append(batch.slice(at, cut - at))
                size += int(bytes_up_to[cut] - bytes_up_to[at])
                last, at = mini[cut - 1], cut
        if held:
            yield flush(held)

    return run


def repeated_windows(rows: DataFrame, unit: str, width: int, gram: int, judge: Callable, later_only: bool) -> DataFrame:
    """(id, hash, begin, end): unit ranges of ``rows`` (from ``keyed``) that repeated windows cover.

    ``judge(packed, copies, first, width)`` gets distinct runs of whole minimisers, how often each occurs and its
    smallest id, and returns run number, window range and the smallest id of those windows for every range that
    counts. With ``later_only`` a window counts only for ids greater than the smallest id that has it.
    """
    runs = rows.mapInArrow(_runs(unit, width, gram), "id long, hash binary, mini long, body long, start long, windows int")
    shared = (
        runs.groupBy("mini")
        .agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"), F.min("id").alias("known"), F.max("id").alias("last"))
        .where("n > 1 AND known < last" if later_only else "n > 1")
        .select("mini", "known", (F.col("low") != F.col("high")).alias("contested"), (F.col("n") > CROWD).alias("crowded"))
    )
    shared = cut_lineage(shared, "shared-minimisers")  # the join then meets two plain exchanges, which may be split where a key is hot
    # both uses of this join need all its columns, so both read one exchange of the runs
    marked = runs.join(shared, "mini")
    place = F.struct("id", "hash", "start", "windows", "crowded")
    distinct = marked.where("contested").groupBy("mini", "body").agg(F.min(place).alias("p"), F.count("*").alias("copies"))
    chosen = distinct.groupBy("p.id", "p.hash").agg(
        F.collect_list(F.struct("p.start", "p.windows", "mini", "p.crowded", "body", "copies", F.col("p.id").alias("first"))).alias("chosen")
    )
    packed = (
        rows.join(chosen, ["id", "hash"])
        .dropDuplicates(["id", "hash"])
        .select("text", "chosen")
        .mapInArrow(_cut(unit, width), "mini long, body long, copies long, first long, crowded boolean, packed binary")
    )
    some = shared.where("contested AND crowded").limit(1).count() > 0
    if some:
        packed = cut_lineage(packed, "contested-runs")  # read by both ways of judging
    findings = (
        (packed.where("NOT crowded") if some else packed)
        .select("mini", "body", "copies", "first", "packed")
        .repartition("mini")
        .sortWithinPartitions("mini")
        .mapInArrow(_judged(judge, width), "mini long, body long, begin long, end long, smallest long")
    )
    if some:
        findings = findings.union(_counted(packed.where("crowded"), unit, width))
    # a run that is not contested is found as a whole
    found = marked.join(findings, ["mini", "body"], "left").where(~F.col("contested") | F.col("begin").isNotNull())
    if later_only:
        found = found.where(F.col("id") > F.coalesce("smallest", "known"))
    return found.select(
        "id",
        "hash",
        (F.col("start") + F.coalesce("begin", F.lit(0))).alias("begin"),
        (F.col("start") + F.coalesce("end", F.col("windows")) + F.lit(width - 1)).alias("end"),
    )


def runs_of(flag: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last index of maximal runs of set flags with one group and one value."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(flag), bool)
    change[1:] = (flag[1:] != flag[:-1]) | (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(change)
    stop = np.append(first[1:], len(flag))
    keep = flag[first]
    return first[keep], stop[keep]


def kept_and_removed(units: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed ranges of a text of ``units`` units from overlapping ranges."""
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.zeros(units + 1, np.int64)
    np.add.at(edges, begins, 1)
    np.add.at(edges, ends, -1)
    gone = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    return np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])


def attach_ranges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the list ``cuts`` of ranges (null: none); every copy of a row gets its ranges."""
    lists = found.groupBy("id", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("cuts"))
    return rows.join(lists, ["id", "hash"], "left")
