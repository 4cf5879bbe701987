"""Merkle manifest of a table as a persistent, path-copying tree.

Method. Rows become leaves, leaves are numbered by key inside their group, and runs of ``FANOUT`` consecutive
nodes hash to a node of the next level, up to one node per group; these nodes make the last tree, up to the root.
The tree is immutable: a tampered leaf makes a *version* of it, in which only the ancestors of that leaf are copied,
while every other node is shared. The work is cut into aligned blocks of ``BLOCK`` nodes: one task holds the
``LEVELS`` levels of a block and hands its top node on; the tops are the nodes of the next band of levels, again in
blocks, until every group has one node. Then the bands are walked back: each block learns the path from its top to
the root (one row per block), and the task that holds a block of leaves copies the ancestors of every version
inside the block and goes on along that path, so versions are as distributed as the leaves.

A block has at most ``BLOCK`` rows whatever the size of its group, so neither a task nor the driver sees more than
that at once. Equal rows are spread by their place in the input before they are numbered.

Defined results: a null key comes first in its group; a null group is a group of its own and comes first; null
fields hash as ``-``, empty ones as ``0:``; rows with one key are ordered by their leaf; repeated rows have a leaf
each; a null in a tampered field stays; an empty table gives no row; other columns take no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.session import materialize

#: Children of a node, levels that one task builds at once, and the leaves of such a block.
FANOUT = 2
LEVELS = 10
BLOCK = FANOUT**LEVELS
#: Stands for the node itself in a level of a path: digests to its left, this mark, digests to its right.
HERE = "*"


def framed(value: Column) -> Column:
    """Unambiguous text of a field: byte count, colon, value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of framed fields."""
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def node_hash(text: str) -> str:
    """A node: the hash of its children's digests as hex text."""
    return hashlib.sha256(text.encode()).hexdigest()


class Block:
    """The nodes of one aligned block of a persistent tree."""

    def __init__(self, bottom: list[str], levels: int):
        self.levels = [bottom]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([node_hash("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, place: int) -> list[str]:
        """What surrounds the ancestors of a bottom node, one text per level."""
        out = []
        for nodes in self.levels[:-1]:
            first = place - place % FANOUT
            out.append("".join(nodes[first:place]) + HERE + "".join(nodes[place + 1 : first + FANOUT]))
            place //= FANOUT
        return out


def copied(changed: str, path: list[str]) -> list[str]:
    """The nodes that a version copies: the changed node and its ancestors, bottom up."""
    out = [changed]
    for level in path:
        out.append(node_hash(level.replace(HERE, out[-1])))
    return out


def numbered(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Add ``tree`` (text of the group), ``at`` (place in the group's order, from 0) and ``size`` of the group.

    Rows are dealt to ranges of (group, keys, place in the input) and numbered inside; only one row per range and
    group is summed up to shift the numbers.
    """
    order = [F.col(c).asc_nulls_first() for c in (group, *keys, "salt")]
    dealt = (
        rows.withColumns({"salt": F.monotonically_increasing_id(), "tree": framed(F.col(group))})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("salt")
        .withColumns({"range": F.spark_partition_id(), "id": F.monotonically_increasing_id()})
    )
    dealt = materialize(dealt, "manifest-order")
    counts = dealt.groupBy("tree", "range").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "tree", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    return (
        dealt.join(shifts, ["tree", "range"])
        .withColumn("at", F.col("id") + F.col("shift"))
        .drop("range", "id", "shift")
    )


def _height(size: Column) -> Column:
    """Levels above the leaves until one node is left."""
    levels = F.lit(0)
    for k in range(62):
        levels = levels + (size > F.lit(FANOUT**k)).cast("int")
    return levels


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / F.lit(BLOCK)).cast("long"))


def _tops(nodes: DataFrame) -> DataFrame:
    """The blocks of a band as nodes of the next one: ``tree, at, hash, height``."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        height = int(group["height"].iloc[0])
        done = min(LEVELS, height)
        block = Block(list(group["hash"]), done)
        return pd.DataFrame(
            {"tree": [group["tree"].iloc[0]], "at": [int(group["block"].iloc[0])], "hash": [block.top], "height": [height - done]}
        )

    return _blocked(nodes.select("tree", "at", "hash", "height")).groupBy("tree", "block").applyInPandas(
        top, "tree string, at long, hash string, height int"
    )


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, at, path, top`` of every node: what surrounds its ancestors, and the node that its tree ends in."""
    if levels == 0:
        return nodes.select("tree", "at", F.array().cast("array<string>").alias("path"), F.col("hash").alias("top"))
    nodes = materialize(nodes, "manifest-nodes")
    upper = _climbed(_tops(nodes), max(0, levels - LEVELS))

    def join(key, group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        block = Block(list(group["hash"]), min(LEVELS, int(group["height"].iloc[0])))
        rest = list(above["path"].iloc[0])
        return pd.DataFrame(
            {
                "tree": group["tree"].to_numpy(),
                "at": group["at"].to_numpy(),
                "path": [block.path(i) + rest for i in range(len(group))],
                "top": above["top"].iloc[0],
            }
        )

    own = _blocked(nodes).groupBy("tree", "block")
    over = upper.withColumnRenamed("at", "block").groupBy("tree", "block")
    return own.cogroup(over).applyInPandas(join, "tree string, at long, path array<string>, top string")


def manifest(rows: DataFrame, group: str, key: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """Manifest of all rows: ``key, leaf, subroot, root, path, version``.

    ``path`` has one text per level from the leaf to the root (siblings around ``HERE``); ``tampered`` gives the
    columns of a tampered row, and ``version`` the nodes that its version copies, changed leaf first, root last.
    An untampered row's version is its own path, hashed again.
    """
    changed = tampered or {}
    leaves = rows.select(
        F.col(key).alias("key"),
        F.col(group).alias("group"),
        leaf_hash([F.col(f) for f in fields]).alias("hash"),
        leaf_hash([changed.get(f, F.col(f)) for f in fields]).alias("changed"),
    )
    nodes = numbered(materialize(leaves, "manifest-leaves"), "group", ["key", "hash"])
    nodes = materialize(nodes.withColumn("height", _height(F.col("size"))).drop("size"), "manifest-nodes")
    levels = nodes.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    upper = materialize(_climbed(_tops(nodes), max(0, levels - LEVELS)), "manifest-paths")

    # One node per group; together they are the leaves of the last tree.
    groups = nodes.where("at = 0").select("tree", "group")
    subroots = upper.where("at = 0").select("tree", "top").join(groups, "tree")
    last = numbered(subroots.withColumn("whole", F.lit("")).withColumnRenamed("tree", "own"), "whole", ["group"])
    last = materialize(
        last.select("own", "tree", "at", F.col("top").alias("hash"), _height(F.col("size")).alias("height")), "manifest-subroots"
    )
    height = last.agg(F.coalesce(F.max("height"), F.lit(0))).first()[0]
    ends = _climbed(last.select("tree", "at", "hash", "height"), height).join(last.select("own", "at"), "at")
    ends = ends.select(F.col("own").alias("tree"), F.col("path").alias("end"), F.col("top").alias("root"))
    upper = upper.join(ends, "tree")

    # Keys travel as text, since pandas would turn whole numbers beside nulls into floating-point ones.
    schema = "key string, leaf string, subroot string, root string, path array<string>, version array<string>"

    def build(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        block = Block(list(group["hash"]), min(LEVELS, int(group["height"].iloc[0])))
        over = above.iloc[0]
        rest = [*over["path"], *over["end"]]
        paths = [block.path(i) + rest for i in range(len(group))]
        return pd.DataFrame(
            {
                "key": group["key"].to_numpy(),
                "leaf": group["hash"].to_numpy(),
                "subroot": over["top"],
                "root": over["root"],
                "path": paths,
                "version": [copied(h, p) for h, p in zip(group["changed"], paths)],
            }
        )

    own = _blocked(nodes.withColumn("key", F.col("key").cast("string"))).groupBy("tree", "block")
    over = upper.withColumnRenamed("at", "block").groupBy("tree", "block")
    built = own.cogroup(over).applyInPandas(build, schema)
    return built.select(F.col("key").cast(rows.schema[key].dataType).alias(key), *built.columns[1:])


def digests(table: DataFrame) -> DataFrame:
    """The paths and versions of a manifest as digests: proof, recomputed root, and whether it equals the root."""
    siblings = F.replace(F.array_join("path", ""), F.lit(HERE), F.lit(""))
    return table.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": F.element_at("version", -1)}).select(
        table.columns[0], "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
