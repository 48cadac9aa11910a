"""Merkle manifest of a dataset: nested-interval labels, containment joins, siblings by interval difference.

Every row is a leaf. Leaves of one group ascend by id and get ranks; every two consecutive nodes become their digest
until one is left, and the remaining nodes of all groups, ordered by group, go on in the same way to the root. A node
carries its level and the interval of leaf ranks that it covers, so

* the ancestors of a node are the nodes whose interval contains its interval;
* the siblings of the node below an ancestor are what is left of the ancestor's interval without the node's.

Levels are taken in bands of ``BAND``: one aggregate builds the subtrees over ``2 ** BAND`` consecutive nodes, whose
topmost nodes are the leaves of the next band. A subtree is one row, with the nodes that it nests. The join that
attaches ancestors meets a member with the subtree on top of it by group and bucket (the member's place divided by the
width of the band's highest level); the containment of intervals then picks the ancestors among the nested nodes. So a
subtree is asked for by at most ``2 ** BAND`` members, however large the tree, and the path of a row is its path in
the lowest band followed by that of its subtree. Ranks come from one range partition of narrow rows, numbered in place
and shifted by the counts of the partitions before, so no group is ordered in one task. Nothing but the root and the
largest group's size comes to the driver.

Defined cases: a null group is a group of its own and leads. Null ids come first; rows of one id are ordered by their
digest; rows that are equal throughout are leaves of their own. A null field counts as ``-``. A group of one row is
its own top. An empty table has no rows. Fields are named by the caller, other columns are ignored whatever their
names; a very long text is digested as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.session import cut_lineage

#: Levels that one aggregate builds.
BAND = 5


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within ``group`` by ``order``, and ``n``, the rows of the group. Nulls lead."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # equal rows may be many, too, so their place in the input is the last key
    marked = rows.withColumn("_mark", F.monotonically_increasing_id())
    ranged = marked.repartitionByRange(*keys, "_mark").sortWithinPartitions(*keys, "_mark").drop("_mark")
    # the upper bits have the partition, the lower 33 the place in it
    stored = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    stored = stored.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(2**33 - 1))
    counts = stored.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    within = Window.partitionBy(group)
    earlier = F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(
        group, "_part", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias("n")
    )
    # one row per range partition and group, so each key has the rows of one partition
    return stored.join(shifts, [group, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _subtree(nodes: Column, whole: Column) -> Column:
    """``nodes`` and the levels above: ``BAND`` of them, or up to the only node where the group ends in this band."""

    def pairs(x: Column) -> Column:
        last = ((F.size(x) - 1) / 2).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.concat_ws("", F.slice(x, 2 * i + 1, 2)), 256))

    def grown(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        return F.when(whole & (F.size(top) == 1), levels).otherwise(F.concat(levels, F.array(pairs(top))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(BAND)), F.array(nodes).cast("array<array<string>>"), grown)


def _nested(levels: Column, base: int) -> Column:
    """Labelled nodes of a subtree above its members, from the lowest level up: level, interval and children."""
    shift = lambda value, by: F.call_function("shiftleft", value, by)
    interval = lambda place, level: (
        shift(place, level).alias("low"),
        (F.least(shift(place + 1, level), F.col("n")) - 1).alias("high"),
    )

    def one_level(h: Column) -> Column:
        first = shift(F.col("block"), (F.lit(BAND) - h).cast("int"))  # place of the leftmost node of this level
        children = lambda i: F.transform(
            F.slice(levels[h - 1], 2 * i + 1, 2),
            lambda d, j: F.struct(*interval(2 * (first + i) + j, base + h - 1), F.unhex(d).alias("digest")),
        )
        return F.transform(levels[h], lambda d, i: F.struct((base + h).alias("level"), *interval(first + i, base + h), children(i).alias("children")))

    heights = F.filter(F.sequence(F.lit(1), F.lit(BAND)), lambda h: h < F.size(levels))
    return F.flatten(F.transform(heights, one_level))


_STEPS = "array<struct<left:binary,right:binary>>"


def _attach(members: DataFrame, subtrees: DataFrame, base: int) -> DataFrame:
    """``members`` (group, idx, n and more) with their group's ``top`` and ``steps``: the siblings left and right of each
    ancestor, lowest level first."""
    low = F.call_function("shiftleft", F.col("idx"), F.lit(base))
    high = F.least(F.call_function("shiftleft", F.col("idx") + 1, F.lit(base)), F.col("n")) - 1
    contains = lambda node, a, b: (node.low <= a) & (b <= node.high)
    digest_of = lambda found: F.get(F.transform(found, lambda c: c.digest), 0)
    ancestors = F.filter("nested", lambda v: contains(v, F.col("own_low"), F.col("own_high")))
    steps = F.transform(
        ancestors,
        lambda v: F.struct(
            digest_of(F.filter(v.children, lambda c: c.high < F.col("own_low"))).alias("left"),
            digest_of(F.filter(v.children, lambda c: c.low > F.col("own_high"))).alias("right"),
        ),
    )
    bucketed = members.withColumn("bucket", F.shiftright("idx", BAND)).withColumn("own_low", low).withColumn("own_high", high)
    over = subtrees.select("group", F.col("block").alias("bucket"), "nested", "upper", "top")
    return (
        bucketed.join(over, ["group", "bucket"])
        .withColumn("steps", F.concat(steps.cast(_STEPS), "upper"))
        .drop("bucket", "own_low", "own_high", "nested", "upper")
    )


@dataclass
class Forest:
    """Per band its subtrees; those with ``ends`` hold the top of their group."""

    bands: list[DataFrame]

    def tops(self) -> DataFrame:
        """(group, digest)"""
        return _union([b.where("ends") for b in self.bands]).select("group", "digest")

    def nodes(self) -> DataFrame:
        """(group, level, low, high, children) of all nodes above the leaves."""
        return _union([b.select("group", F.explode("nested").alias("v")) for b in self.bands]).select("group", "v.*")

    def paths(self, leaves: DataFrame, above: DataFrame | None = None) -> DataFrame:
        """``leaves`` with ``top`` and ``steps``, the siblings left and right of every ancestor.

        ``above`` (group, above) has steps that follow those of a whole group. They join the topmost subtrees, so no
        join brings the leaves of a group together.
        """
        none = F.array().cast(_STEPS)
        over = None
        for k in range(len(self.bands) - 1, -1, -1):
            topmost = self.bands[k].where("ends").withColumn("top", F.col("digest"))
            if above is None:
                topmost = topmost.withColumn("upper", none)
            else:
                topmost = topmost.join(above.withColumnRenamed("above", "upper"), "group")
            done = topmost.select("group", "block", "nested", "upper", "top")
            if over is not None:
                below = self.bands[k].where("NOT ends").select("group", F.col("block").alias("idx"), "n", F.col("nested").alias("mine"))
                reached = _attach(below, over, (k + 1) * BAND)
                done = done.union(reached.select("group", F.col("idx").alias("block"), F.col("mine").alias("nested"), F.col("steps").alias("upper"), "top"))
            over = done
        return _attach(leaves.withColumn("idx", F.col("rank")), over, 0).drop("idx")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.union(more)
    return out


def grow(leaves: DataFrame) -> Forest | None:
    """Trees over ``leaves`` (group, rank, n, digest), one per group. ``leaves`` should be stored, as it is read several times."""
    largest = leaves.agg(F.max("n")).first()[0]
    if largest is None:
        return None
    # idx: place of the node on level ``base``; n: leaves of the group
    current = leaves.select("group", F.col("rank").alias("idx"), "n", "digest")
    base, bands = 0, []
    while True:
        ends = F.col("n") <= 1 << (base + BAND)
        built = (
            current.groupBy("group", F.shiftright("idx", BAND).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("given"), F.first("n").alias("n"))
            .withColumn("given", F.transform("given", lambda x: _hex(x.digest)))
            .withColumn("levels", _subtree(F.col("given"), ends))
            .select(
                "group", "block", "n", ends.alias("ends"), _nested(F.col("levels"), base).alias("nested"),
                F.unhex(F.element_at("levels", -1)[0]).alias("digest"),
            )
        )
        bands.append(cut_lineage(built, "merkle-subtrees"))
        base += BAND
        if largest <= 1 << base:
            break
        current = bands[-1].where("NOT ends").select("group", F.col("block").alias("idx"), "n", "digest")
    return Forest(bands)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    text = lambda c: F.coalesce(_hex(c), F.lit(""))
    return F.aggregate(steps, leaf, lambda below, s: digest(text(s.left), below, text(s.right)))


def prove_rows(
    docs: DataFrame, fields: list[str], id_name: str = "doc_id", group: str = "lang", claimed: dict[str, Column] | None = None, when: Column | None = None
) -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, folded_root, verified), one row per row of ``docs``.

    A leaf is the digest of ``fields``. Where ``when`` holds, ``folded_root`` starts from the leaf with the values
    ``claimed`` in place of the fields of those names, as a reader would get it from a changed row.
    """
    own = digest(*(framed(F.col(c)) for c in fields))
    other = digest(*(framed((claimed or {}).get(c, F.col(c))) for c in fields))
    rows = docs.select(
        F.col(id_name).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),  # keeps the order, null first
        F.unhex(own).alias("digest"),
        (F.unhex(F.when(when, other)) if when is not None else F.lit(None).cast("binary")).alias("claimed"),
    )
    leaves = cut_lineage(ranked(cut_lineage(rows, "leaves"), "group", ["id", "digest"]), "ranked-leaves")
    trees = grow(leaves)
    if trees is None:
        kind = rows.schema["id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {kind}, leaf string, subroot string, root string, siblings array<string>, folded_root string, verified boolean"
        )
    tops = ranked(trees.tops().select(F.lit("").alias("all"), F.col("group").alias("of"), F.col("digest")), "all", ["of"])
    tops = cut_lineage(tops.withColumnRenamed("all", "group"), "subroots")
    upper = grow(tops)
    root = upper.tops().select(_hex(F.col("digest"))).first()[0]
    above = upper.paths(tops).select(F.col("of").alias("group"), F.col("steps").alias("above"))
    proven = trees.paths(leaves, above)
    siblings = F.filter(F.flatten(F.transform("steps", lambda s: F.array(_hex(s.left), _hex(s.right)))), lambda x: x.isNotNull())
    return proven.select(
        F.col("id").alias("doc_id"),
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("top")).alias("subroot"),
        F.lit(root).alias("root"),
        siblings.alias("siblings"),
        folded(_hex(F.coalesce("claimed", "digest")), F.col("steps")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
