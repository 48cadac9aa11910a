"""N-gram Jaccard join with several global token orders.

A document is the set of its distinct word shingles, of four words unless told otherwise. Sets with intersection over
union of at least 0.85 (``percent``) share a token among the first n - ceil(0.85 n) + 1 tokens of each under *any* common order of all tokens. A pair is a
candidate only if that holds under every one of several orders; only then are the whole sets compared.

* Equal sets are one class from the start; everything below is about classes.
* All orders put frequent tokens last. Frequency is read from a table of counters of fixed size, filled from all
  documents; tokens of one frequency level are ordered by a hash, and each order has its own hash. An order need not
  know exact frequencies, it only has to be the same for all documents, so no link is lost.
* The first order makes the postings. A pair counts at a token only if enough of both sets is left from there on. In
  every posting list each class meets the list's first ``LEADERS`` classes, those with the fewest rarer tokens, which
  is every other class in a short list. In longer lists the classes still in another component than most of the
  list then meet all of the list from other components. Pairs inside one component are not looked at, so a group of
  near copies costs about its size, and no link between components is missed.
* Before any text travels, pairs are dropped whose counts over 128 token classes differ by more than linked sets can.
* Only texts of the pairs left travel: a bit table of fixed size, filled from the digests of these, drops most others
  where they are read, and an equi-join the rest.
* Candidates are compared where the leader's set is; members' texts come by, sorted behind it, one at a time. Common
  leaders are spread over salted copies.

Defined cases: null or empty text has no shingles and links with nothing. Under a shingle's words the whole sequence is
the one shingle. A null id sorts after all ids; a component of only such rows has a null id. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

from .arrays import LOWER, find_words, mix, pieces, prefix_hashes, span_hashes, text_bytes, window_hashes, word_hashes
from .components import connected_components
from .windows import NO_ID, keyed

SHINGLE = 4
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Seeds of the token orders.
ORDERS = (1, 2, 3)
#: Counters of the frequency table, as a power of two, and counters per row of it.
COUNTER_BITS = 24
SLICE_BITS = 16
LEADERS = 4
#: Slots of the table that tells which texts are asked for, as a power of two.
MARK_BITS = 26
#: Text that is worked on at once; the arrays of a piece have some fifty times its bytes.
PIECE_BYTES = 500_000
#: Token classes that are counted per document to tell unlike sets apart before any text travels.
SPREAD = 128
#: Members of a leader per salted copy of its text.
MEMBERS_PER_COPY = 2000


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, rows = find_words(data, offsets)
    prefix = prefix_hashes(word_hashes(data, starts, ends))
    windows = window_hashes(prefix, shingle)
    whole = mix(span_hashes(prefix, rows[:-1], rows[1:]) + np.uint64(1))  # a short text is no shingle of a longer one
    out = []
    for i, (a, z) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
        out.append(np.unique(windows[a : z - shingle + 1]) if z - a >= shingle else whole[i : i + (z > a)])
    return out


def set_digest(tokens: np.ndarray) -> int:
    return int(mix(np.bitwise_xor.reduce(mix(tokens), keepdims=True) + np.uint64(len(tokens))).view(np.int64)[0]) if len(tokens) else 0


def spread(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of ``SPREAD`` classes (255: as many or more)."""
    return np.minimum(np.bincount((tokens % np.uint64(SPREAD)).astype(np.int64), minlength=SPREAD), 255).astype(np.uint8).tobytes()


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class TokenOrder:
    """Keys that order tokens: frequency level first, then a hash of the order's own.

    The first order has a level per count up to 127 and eight per doubling beyond; the others have coarse levels, which
    tell common tokens from the rest and leave the order among the rest to their hashes.
    """

    def __init__(self, fine: np.ndarray):
        self.fine, self.shift = fine, np.uint64(64 - int(len(fine)).bit_length() + 1)
        every = np.arange(256.0)
        counts = np.where(every < 128, every, 128 * 2 ** ((every - 128) / 8))
        unit = 2 * (np.bincount(fine, minlength=256) @ counts) // len(fine) + 1
        self.coarse = np.frexp(counts // unit)[1].astype(np.uint8)

    @staticmethod
    def levels(counters: np.ndarray) -> np.ndarray:
        beyond = 128 + 8 * np.log2(np.clip(counters, 128, 2**23) / 128)
        return np.where(counters < 128, counters, np.minimum(beyond, 255)).astype(np.uint8)

    def keys(self, tokens: np.ndarray, order: int) -> np.ndarray:
        level = self.fine[(mix(tokens) >> self.shift).astype(np.int64)]
        level = (level if order == ORDERS[0] else self.coarse[level]).astype(np.uint64)
        return (level << np.uint64(56)) | (mix(tokens ^ np.uint64(0x51ED270B * order)) >> np.uint64(8))

    def prefix(self, tokens: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
        size = prefix_size(len(tokens), percent)
        keys = self.keys(tokens, order)
        return np.sort(np.partition(keys, size - 1)[:size]) if size else keys


def _profiles(shingle: int):
    """One row per document, and at the end of the task its counters in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, np.uint16)
        names = ["id", "hash", "n", "class", "spread", "slice", "counts"]
        for batch in pieces(batches, "text", PIECE_BYTES):
            sets = shingle_sets(batch.column(2), shingle)
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at, times = np.unique((mix(every) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), return_counts=True)
            counters[at] = np.minimum(counters[at] + times, 65_000)
            nothing = pa.nulls(len(sets))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_digest, sets), pa.int64()),
                 pa.array(map(spread, sets), pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        for k, part in enumerate(np.minimum(counters, 255).astype(np.uint8).reshape(-1, 1 << SLICE_BITS)):
            if part.any():
                yield pa.record_batch(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), "zstd", asbytes=True)], pa.binary())], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(pa.decompress(counts, 1 << SLICE_BITS, "zstd", asbytes=True), np.uint8).astype(np.int64)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([TokenOrder.levels(v).tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])


def token_order(profiles: DataFrame) -> TokenOrder:
    """The frequency table has a fixed number of counters, whatever the input."""
    levels = np.zeros((1 << (COUNTER_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    slices = profiles.where("slice IS NOT NULL").select("slice", "counts").repartition("slice")
    for r in slices.mapInArrow(_summed, "slice int, counts binary").toLocalIterator():
        levels[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return TokenOrder(levels.ravel())


def _postings(shared, percent: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in pieces(batches, "text", PIECE_BYTES):
            tokens, classes, sizes, places = [], [], [], []
            for s in shingle_sets(batch.column(2), shingle):
                digest = set_digest(s)
                if len(s) and digest not in seen:  # copies within the task add nothing
                    if len(seen) < 1_000_000:
                        seen.add(digest)
                    p = order.prefix(s, ORDERS[0], percent)
                    tokens.append(p)
                    places.append(np.arange(len(p)))
                    classes.append(digest)
                    sizes.append((len(p), len(s)))
            if tokens:
                counts = [a for a, _ in sizes]
                yield pa.record_batch(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(classes, counts)), pa.array(np.repeat([b for _, b in sizes], counts)),
                     pa.array(np.concatenate(places))],
                    ["token", "class", "n", "place"],
                )

    return run


def _marks(wanted: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, in which the slots of the asked texts are set."""
    slots = wanted.select((_slot() + 1).alias("slot"))
    found = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    marks = np.zeros((1 << (MARK_BITS - 15), 4096), np.uint8)
    for r in found.toLocalIterator():
        marks[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return marks.ravel()


def _slot() -> Column:
    return F.shiftrightunsigned(F.xxhash64("hash"), 64 - MARK_BITS)


def _marked(shared):
    """Rows whose slot is set, without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value
        for batch in batches:
            slots = batch.column(3).to_numpy()
            yield batch.select(["id", "hash", "text"]).filter(pa.array((marks[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1))

    return run


def _asked_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, asked) for every row of ``wanted``; texts that nobody asked for are dropped where they are read."""
    shared = rows.sparkSession.sparkContext.broadcast(_marks(wanted))
    near = rows.select("id", "hash", "text", _slot().alias("slot")).mapInArrow(_marked(shared), "id long, hash binary, text string")
    return near.join(wanted, ["id", "hash"]).dropDuplicates(["id", "hash"]).select("text", "asked")


def _compared(shared, percent: int, shingle: int):
    """Leader rows (member null) come before their members; links are what passes all orders and the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        leader, own, own_prefixes = None, None, None
        for batch in pieces(batches, "text", 200_000):
            out = []
            for name, member, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), shingle), strict=True):
                if member is None:
                    leader, own, own_prefixes = name, tokens, [order.prefix(tokens, k, percent) for k in ORDERS[1:]]
                elif leader == name and all(
                    len(np.intersect1d(p, order.prefix(tokens, k, percent), assume_unique=True))
                    for k, p in zip(ORDERS[1:], own_prefixes, strict=True)
                ):
                    both = len(np.intersect1d(own, tokens, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(tokens) - both):
                        out.append((name, member))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return run


def _verify(pairs: DataFrame, rows: DataFrame, chosen: DataFrame, shared, percent: int, shingle: int) -> DataFrame:
    """Links among (leader, member) pairs. Each member's text travels once per leader, a leader's once per copy.

    A text is shorter than its set, so sets are made where they are compared.
    """
    copies = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS_PER_COPY).cast("int").alias("copies"))
    members = pairs.join(copies, "leader").select(
        F.col("member").alias("class"), "leader", "member", F.pmod(F.col("member"), F.col("copies")).cast("int").alias("salt")
    )
    leaders = copies.select(
        F.col("leader").alias("class"), "leader", F.lit(None).cast("long").alias("member"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    )
    # a class takes part in a bounded number of comparisons per list it is in, so its requests are a short list
    asked = leaders.union(members).groupBy("class").agg(F.collect_list(F.struct("leader", "member", "salt")).alias("asked"))
    wanted = cut_lineage(asked.join(chosen.select("class", "id", "hash"), "class").select("id", "hash", "asked"), "jaccard-asked")
    texts = _asked_texts(rows, wanted).select("text", F.inline("asked"))
    ordered = texts.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return ordered.select("leader", "member", "text").mapInArrow(_compared(shared, percent, shingle), "u long, v long")


def _not_apart(pairs: DataFrame, spreads: DataFrame, percent: int) -> DataFrame:
    """Pairs whose counts per token class allow a link.

    The counts of two sets differ by at most the number of tokens that only one of them has, and linked sets have at
    most (100 - percent) / (100 + percent) of their summed sizes of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SPREAD).astype(np.int16) for k in (3, 4)]
            apart = np.abs(counts[0] - counts[1]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * batch.column(2).to_numpy()
            yield pa.record_batch(batch.columns[:2], ["leader", "member"]).filter(pa.array(near))

    side = lambda name: spreads.select(F.col("class").alias(name), F.col("n").alias(f"n_{name}"), F.col("spread").alias(f"spread_{name}"))
    both = pairs.join(side("leader"), "leader").join(side("member"), "member")
    return both.select("leader", "member", F.col("n_leader") + F.col("n_member"), "spread_leader", "spread_member").mapInArrow(run, "leader long, member long")


def _fitting(percent: int):
    """Whether this may be the first common token of a linked pair.

    The sizes must allow a link, and so must what is left of both sets from this token on: linked sets have at least
    percent / (100 + percent) of their summed sizes in common, and all of it from their first common token on.
    """
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q"))
    return (
        (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        & ((100 + percent) * left >= percent * (F.col("n") + F.col("m")))
        & (F.col("leader") != F.col("member"))
    )


def similar_groups(docs: DataFrame, percent: int = PERCENT, id_name: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, hash, n_shingles, component, group): every row with the size of its set and the smallest id it is connected to.

    ``group`` tells the groups apart (null without a set): two of them may have one smallest id where ids repeat or lack.
    """
    rows = keyed(docs, id_name, text)
    profiles = cut_lineage(
        rows.mapInArrow(_profiles(shingle), "id long, hash binary, n long, class long, spread binary, slice int, counts binary"), "shingle-profiles"
    )
    order = token_order(profiles)
    shared = docs.sparkSession.sparkContext.broadcast(order)
    people = profiles.where("slice IS NULL").select("id", "hash", "n", "class", "spread")
    postings = (
        rows.mapInArrow(_postings(shared, percent, shingle), "token long, class long, n long, place long")
        .repartition("token")  # one exchange for the lists and their sizes
        .groupBy("token", "class")
        .agg(F.first("n").alias("n"), F.first("place").alias("place"))
    )
    lists = cut_lineage(postings.withColumn("size", F.count("*").over(Window.partitionBy("token"))).where("size > 1"), "postings")
    ranked = F.row_number().over(_by_token())
    leading = lists.select("token", F.col("class").alias("leader"), F.col("n").alias("m"), F.col("place").alias("q"), ranked.alias("k")).where(F.col("k") <= LEADERS)
    first_pairs = (
        lists.withColumnRenamed("class", "member").join(leading, "token").where(_fitting(percent))
        .select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member")).distinct()
    )
    chosen = people.join(lists.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min(F.struct("id", "hash", "n", "spread")).alias("p"))
    chosen = cut_lineage(chosen.select("class", "p.*"), "shingle-spreads")
    first_pairs = cut_lineage(_not_apart(first_pairs, chosen, percent), "jaccard-pairs")
    links = cut_lineage(_verify(first_pairs, rows, chosen, shared, percent, shingle), "jaccard-links")
    labels = connected_components(links)
    rest = _pairs_between(lists.where(F.col("size") > LEADERS + 1), labels, percent)
    rest = cut_lineage(_not_apart(rest, chosen, percent), "jaccard-pairs")
    if not rest.isEmpty():
        labels = connected_components(links.union(_verify(rest, rows, chosen, shared, percent, shingle)))
    smallest = people.where("n > 0").groupBy("class").agg(F.min("id").alias("own"))
    of_class = smallest.join(labels.select(F.col("u").alias("class"), F.col("v").alias("label")), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    component = of_class.groupBy("label").agg(F.min("own").alias("component"))
    known = of_class.join(component, "label").select("class", "component", F.col("label").alias("group"))
    found = people.join(known, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return found.select("id", "hash", F.col("n").alias("n_shingles"), component.alias("component"), "group")


def _by_token():
    """Classes with the fewest rarer tokens first: the middle of a group of near copies leads it."""
    return Window.partitionBy("token").orderBy("place", "class")


def _pairs_between(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one posting list in different components, without those inside the list's largest component."""
    labelled = lists.join(labels.select(F.col("u").alias("class"), F.col("v").alias("label")), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    sizes = labelled.groupBy("token", "label").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    mixed = labelled.join(largest.select("token", F.col("top.label").alias("top")), "token")
    minor = mixed.where("label != top").select("token", F.col("class").alias("leader"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("label").alias("other"))
    return (
        mixed.select("token", F.col("class").alias("member"), "n", "place", "label").join(minor, "token")
        .where(_fitting(percent) & (F.col("label") != F.col("other")))
        .select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member")).distinct()
    )


def component_ids(docs: DataFrame, percent: int = PERCENT, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    absent = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return similar_groups(docs, percent, id_name, text).select(
        absent("id").alias("doc_id"), "n_shingles", absent("component").alias("component_id")
    )
