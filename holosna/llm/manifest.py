"""Merkle manifest of a table: a digest of every row, its authentication path, and the root that the path leads to.

Rows are leaves of one binary tree a group, in order; the groups' roots are leaves of the tree on top. Leaves are dealt
in aligned blocks of 2**BLOCK_BITS. A task reads a block's leaves in order and schedules its traversal (Merkle; Szydlo,
2004): a node of the path is kept for each height, and a treehash stack for each height works on the node that takes its
place next, two units of work a leaf; so besides the block's leaves it holds nodes in proportion to the square of the
block's height, and no leaf costs more than another. A block's root is a leaf of the tree above, which is dealt in blocks
likewise, until each group has one node; its paths are shared by the block's leaves, and are put behind theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holosna.llm.common import bounded, ranked, small, stored

BLOCK_BITS = 8
#: Units of work (a leaf read, or two nodes joined) that each height's stack may do a leaf.
UNITS = 2


def digest(columns: list[Column]) -> Column:
    """sha256 (lowercase hex) of the columns: each "-" if null, else its UTF-8 bytes' count, ":", and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def joined(left: str | None, right: str | None) -> str | None:
    """The node over two nodes of a height; the last one may be alone, and behind it there is none."""
    return None if left is None else hashlib.sha256((left + (right or "")).encode()).hexdigest()


class Treehash:
    """A stack that builds the node of a height over the leaves from start on, a unit of work at a time."""

    def __init__(self, leaf: Callable[[int], str | None], height: int, start: int):
        self.leaf, self.height, self.at, self.stack = leaf, height, start, []

    def work(self, units: int) -> None:
        stack = self.stack
        for _ in range(units):
            if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                h, right = stack.pop()
                stack[-1] = (h + 1, joined(stack[-1][1], right))
            elif not stack or stack[0][0] < self.height:
                stack.append((0, self.leaf(self.at)))
                self.at += 1
            else:
                return

    def node(self) -> str | None:
        return self.stack[0][1]


def paths(leaves: list[str], height: int) -> Iterator[list[str | None]]:
    """For each leaf in turn the nodes beside its way up through so many heights; None where a node is the last and alone."""

    def leaf(i: int) -> str | None:
        return leaves[i] if i < len(leaves) else None

    beside: list[str | None] = []
    for h in range(height):  # the first leaf's path: the second node of each height
        first = Treehash(leaf, h, 1 << h)
        first.work(2 << h)
        beside.append(first.node())
    ahead = [Treehash(leaf, h, 0) for h in range(height)]
    for t in ahead:
        t.work(2 << t.height)
    for i in range(len(leaves)):
        yield list(beside)
        for h in range(height):
            if (i + 1) % (1 << h) == 0:
                beside[h] = ahead[h].node()
                ahead[h] = Treehash(leaf, h, (i + 1 + (1 << h)) ^ (1 << h))
        for t in ahead:
            t.work(UNITS)


def root(leaves: list[str], height: int) -> str:
    whole = Treehash(lambda i: leaves[i] if i < len(leaves) else None, height, 0)
    whole.work(2 << height)
    return whole.node()


def heights(n: int, bits: int) -> int:
    """Heights that a block's tree has: up to its group's root if the block holds the whole group."""
    return bits if n > 1 << bits else (n - 1).bit_length()


def traversed(nodes: DataFrame, bits: int) -> DataFrame:
    """grp, at, n, path and, in a block's last row, top (the block's root) of nodes (grp, at, n, node)."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        leaves, n = rows.column("node").to_pylist(), rows.column("n")[0].as_py()
        height = heights(n, bits)
        top = [None] * (len(leaves) - 1) + [root(leaves, height)]
        return pa.RecordBatch.from_arrays(
            [rows.column("grp").combine_chunks(), rows.column("at").combine_chunks(), rows.column("n").combine_chunks(), pa.array(list(paths(leaves, height)), pa.list_(pa.string())), pa.array(top, pa.string())],
            names=["grp", "at", "n", "path", "top"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            at, grp = now.column("at").to_numpy() >> bits, now.column("grp")
            new = at[1:] != at[:-1]
            if now.num_rows > 1:
                new |= pa.compute.not_equal(grp[1:], grp[:-1]).to_numpy()
            edge = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield whole(now.slice(a, b - a))
            held = now.slice(edge[-1])
        if held is not None and held.num_rows:
            yield whole(held)

    rows = nodes.select("grp", "at", "n", "node").repartition("grp", F.shiftright("at", bits)).sortWithinPartitions("grp", "at")
    return bounded(rows).mapInArrow(run, "grp string, at long, n long, path array<string>, top string")


def tree(nodes: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """grp, at, path (nodes beside, from the leaf's height up; null where there is none) and root of nodes (grp, at, n, node).

    nodes: a row for each place from 0 to n - 1 of each grp (a text, not null). Every 2 nodes in turn are joined, the last
    one alone if need be, until one is left.
    """
    tiers, now = [], nodes
    while True:
        tiers.append(stored(traversed(now, bits), "tier"))
        most = tiers[-1].agg(F.max("n")).first()[0] or 0
        now = tiers[-1].where("top IS NOT NULL").select("grp", F.shiftright("at", bits).alias("at"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), F.col("top").alias("node"))
        if most <= 1 << bits:
            break
    upper = now.select("grp", "at", F.array().cast("array<string>").alias("above"), F.col("node").alias("root"))
    for k, tier in enumerate(reversed(tiers)):
        upper = small(stored(upper, "upper"), "above") if k else upper
        own = tier.withColumn("block", F.shiftright("at", bits))
        upper = own.join(upper.withColumnRenamed("at", "block"), ["grp", "block"]).select("grp", "at", F.concat("path", "above").alias("above"), "root")
    return upper.withColumnRenamed("above", "path")


def folded(leaf: Column, at: Column, path: Column) -> Column:
    """The root that a leaf at a place and a path of its tree lead to."""
    sides = F.transform(path, lambda x, i: F.struct(x.alias("x"), F.getbit(at, i).alias("right")))
    up = lambda node, s: F.sha2(F.when(s["right"] == 1, F.concat(s["x"], node)).otherwise(F.concat(node, F.coalesce(s["x"], F.lit("")))).cast("binary"), 256)
    return F.aggregate(sides, leaf, up)


def proof(path: Column) -> Column:
    """sha256 of the nodes of a path, in order."""
    return F.sha2(F.array_join(path, "").cast("binary"), 256)


def manifest(docs: DataFrame, columns: list[str], group: str, order: list[str], *carried: Column) -> DataFrame:
    """leaf, subroot, root, own_at, own_path, top_at, top_path of every row of docs, and the carried columns.

    Leaves of a group (null is one, and the first) ascend by order, nulls first, rows that share it by their digests;
    rows repeated whole are leaves each. own_at, own_path: the leaf's place and path in its group's tree; top_at, top_path:
    the group's in the tree of groups. Null, empty and very long texts are digested whole; other columns of docs are not
    looked at. Empty docs: no rows.
    """
    leaves = docs.select(F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(order)), digest([F.col(c) for c in columns]).alias("node"), *carried)
    keys = [F.col(f"__{i}").asc_nulls_first() for i in range(len(order))]
    placed = stored(ranked(stored(leaves, "leaves"), ["grp"], [*keys, F.col("node")]), "placed")
    own = stored(tree(placed), "paths")
    groups = own.where("at = 0").select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("root").alias("node"))
    tops = stored(ranked(groups, ["all"], [F.col("name")]).withColumnRenamed("all", "grp"), "tops")
    top = tree(tops)
    top = stored(tops.join(top, ["grp", "at"]).select(F.col("name").alias("grp"), F.col("node").alias("subroot"), F.col("at").alias("top_at"), F.col("path").alias("top_path"), "root"), "top")
    rows = placed.drop("n", *(f"__{i}" for i in range(len(order)))).withColumnRenamed("node", "leaf")
    rows = rows.join(own.select("grp", "at", F.col("path").alias("own_path")), ["grp", "at"])
    return rows.join(small(top, "top_path"), "grp").withColumnRenamed("at", "own_at").drop("grp")
