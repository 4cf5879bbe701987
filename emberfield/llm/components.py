"""Connected components of a link table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberfield.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.min("v"), F.max("u")
    ).first()
    return tuple(row)


def connected(links: DataFrame, name: str) -> DataFrame:
    """``node, component`` for every end of a link ``a, b``; the component is its smallest node.

    Each round hangs every node on the smallest node it knows and keeps one
    edge per pair; rounds grow with the logarithm of a component's length.
    The smallest neighbour is a map-side aggregate, so a node with very many
    links is folded before the shuffle, and its join is one that adaptive
    execution can split. Each round is written to the shared folder.
    Nulls and self links are ignored; no links give an empty table.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name
    )
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = materialize(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(),
            name,
        )
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
