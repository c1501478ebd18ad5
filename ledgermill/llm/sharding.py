"""K-d tree sharding: documents go into shards of near equal bytes that lie close together in their metadata.

A node for k shards is split at the weighted median (the quantile that leaves
the first half of its shards their share of its bytes) along its widest
metadata dimension, until every leaf is one shard. Dimensions are the
language, the source, the logarithm of the size and the document's number;
width is measured against the whole table's width. Names have no order of
their own, so their hashes stand for them; a fraction from the row's own hash
is added to every coordinate, so that one language, source or size that holds
a third of all rows can be cut anywhere.

All nodes of a level are split together. Medians are found by aggregates
alone: each pass counts bytes in BINS bins between the bounds known so far and
keeps the bin that holds the median. The driver sees at most shards * BINS
sums a pass. The tree becomes one nested CASE expression, so that giving rows
their shards needs no join.

Copies stay together: the rows of one text stand at the point of the copy with
the least doc_id, so that no cut parts them, unless together they have over
SPREAD of a shard's bytes. Such groups (there can't be more than shards / SPREAD)
stand at their rows' own points and are cut like all else: else shards could
not be near equal.

Defined cases: null text has no bytes (size 16, checksum 0); null metadata is a
value like any other; rows that are equal in every column share one point and
so one shard; a null doc_id counts as 0; with fewer documents than shards some shards stay empty; other
columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.llm.common import BROADCAST_ROWS, bounded, stored

OVERHEAD = 16
BINS = 1024
#: A group of copies of over this share of a shard's bytes is spread.
SPREAD = 0.1
#: A median is near enough when it is known to this share of a shard's bytes.
TOLERANCE = 1e-4
DIMENSIONS = ("d_lang", "d_source", "d_size", "d_id")
#: Rows numbered by one task at a time.
SLOT_ROWS = 10_000


@dataclass
class Node:
    first: int
    shards: int
    dim: str | None = None
    cut: float | None = None  # rows at or under it go left
    left: "Node | None" = None
    right: "Node | None" = None
    path: list[tuple[str, bool, float]] = field(default_factory=list)


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text, and the metadata of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _at_one_point(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """rows with `at` (doc_id, lang, source that give the point): a group of copies has its first one's, unless it is over the limit."""
    key = ["text_hash", "text_crc32", "size"]
    own = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "lang", "source")
    groups = stored(rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(own).alias("first")).where("n > 1"))
    big = F.col("bytes") > F.lit(SPREAD * total / shards)
    # At most shards / SPREAD groups are big; the others can't make a hot key.
    marked = rows.join(F.broadcast(groups.where(big).select(*key, F.lit(True).alias("big"))), key, "left")
    few = bounded(groups.where(~big).select(*key, "first"), BROADCAST_ROWS)
    alone = marked.where("big").select(*rows.columns, own.alias("at"))
    return alone.unionByName(marked.where("big is null").join(few, key, "left").select(*rows.columns, F.coalesce("first", own).alias("at")))


def coordinates(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the point of each of rows (see facts and _at_one_point)."""
    unit = F.shiftrightunsigned(F.xxhash64("at.id", "size", "text_hash"), 11) / F.lit(float(1 << 53))
    name = lambda c: (F.shiftrightunsigned(F.xxhash64(F.lit(c), F.coalesce(f"at.{c}", F.lit("\x00"))), 44) + unit) / F.lit(float(1 << 20))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        name("lang").alias("d_lang"),
        name("source").alias("d_source"),
        F.log2(F.col("size") + unit).alias("d_size"),
        (F.col("at.id") + unit).cast("double").alias("d_id"),
    )


def _shard(root: Node, leaf) -> Column:
    if root.left is None:
        return F.lit(leaf(root))
    return F.when(F.col(root.dim) <= F.lit(root.cut), _shard(root.left, leaf)).otherwise(_shard(root.right, leaf))


def _medians(points: DataFrame, root: Node, nodes: list[Node], seen: dict[int, dict], tolerance: float) -> None:
    """Sets the cut of each node (dim is set): aggregates over ever narrower bins."""
    known = {n.first: {"low": seen[n.first]["min_" + n.dim], "high": seen[n.first]["max_" + n.dim], "under": 0} for n in nodes}
    goal = {n.first: seen[n.first]["bytes"] * (n.shards // 2) / n.shards for n in nodes}
    pending = {n.first: n for n in nodes}

    def inside(n: Node) -> Column:
        """Of a row in a pending node and within its bounds: the node, its bin and its coordinate."""
        if n.first not in pending:
            return F.lit(None)
        x, b = F.col(n.dim), known[n.first]
        scale = BINS / ((b["high"] - b["low"]) or 1.0)
        at = F.least(F.lit(BINS - 1), F.floor((x - F.lit(b["low"])) * F.lit(scale))).cast("int")
        return F.when(x.between(b["low"], b["high"]), F.struct(F.lit(n.first).alias("node"), at.alias("bin"), x.alias("x")))

    while pending:
        rows = (
            points.select(_shard(root, inside).alias("s"), "size")
            .groupBy("s.node", "s.bin")
            .agg(F.sum("size").alias("bytes"), F.min("s.x").alias("low"), F.max("s.x").alias("high"))
            .where("node is not null")
            .collect()
        )
        for k in list(pending):
            node, b, under, last = pending[k], known[k], known[k]["under"], known[k].get("last")
            for r in sorted((r for r in rows if r["node"] == k), key=lambda r: r["bin"]):
                if under + r["bytes"] >= goal[k]:
                    break
                under, last = under + r["bytes"], r["high"]
            if r["low"] == r["high"] or r["bytes"] <= tolerance:
                after = under + r["bytes"]  # before or after the last bin, whichever is nearer
                node.cut = r["high"] if last is None or after - goal[k] < goal[k] - under else last
                del pending[k]
            else:
                b |= {"low": r["low"], "high": r["high"], "under": under, "last": last}


def tree(points: DataFrame, shards: int) -> Node:
    """The k-d tree over points (see coordinates) with so many leaves."""
    root, level, width = Node(0, shards), [], None
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        at = _shard(root, lambda n: n.first)
        ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
        seen = {r["node"]: r.asDict() for r in points.groupBy(at.alias("node")).agg(F.sum("size").alias("bytes"), *ends).collect()}
        if width is None and seen:
            width = {d: (seen[0]["max_" + d] - seen[0]["min_" + d]) or 1.0 for d in DIMENSIONS}
        full = [n for n in level if n.first in seen]
        for n in full:
            n.dim = max(DIMENSIONS, key=lambda d: (seen[n.first]["max_" + d] - seen[n.first]["min_" + d]) / width[d])
        if full:
            _medians(points, root, full, seen, TOLERANCE * sum(s["bytes"] for s in seen.values()) / shards)
        after = []
        for n in full:
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
            after += [n.left, n.right]
        level = after
    return root


def with_slots(rows: DataFrame, total: int, shards: int, group: str = "shard") -> DataFrame:
    """rows with `slot`: gapless numbers from 0 within each group. A group is numbered in parts of about SLOT_ROWS rows, which start where the part before ends."""
    parts = max(1, math.ceil(total / shards / SLOT_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "part").count().select(group, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    starts = bounded(stored(starts), BROADCAST_ROWS)
    inside = Window.partitionBy(group, "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("place", F.row_number().over(inside)).join(starts, [group, "part"]).withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long"))


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot and grown_shard (null: the law is not `key`) of every document.

    Give the number of shards, or the bytes that a shard should have.
    """
    known = stored(facts(docs))
    rows, total = known.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards or max(1, math.ceil(total / target_bytes))
    points = stored(coordinates(_at_one_point(known, total, shards)), known)
    placed = points.select("doc_id", "size", "text_crc32", _shard(tree(points, shards), lambda n: n.first).cast("int").alias("shard"))
    return with_slots(placed, rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
