"""Splits by place: hashes of block keys instead of random shuffles.

The rule is a pure function of the place and a seed, so it needs no shuffle,
and a new detection never moves an old block to another split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberfield.constants import TARGET
from emberfield.functions import grid


#: Another seed gives another, unrelated split.
SEED = "emberfield"


def _bucket(a: Column, b: Column, seed: str) -> Column:
    """0 to 99 from the first 8 hex digits of an md5 over seed and place."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), a.cast("long").cast("string"), b.cast("long").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def _named(bucket: Column, train: int, validation: int) -> Column:
    return (
        F.when(bucket < train, "train")
        .when(bucket < train + validation, "validation")
        .otherwise("test")
    )


def block_split(cells: DataFrame, train: int = 60, validation: int = 20, seed: str = SEED) -> DataFrame:
    """60/20/20 by 0.1 degree block: all cells of a block share a split."""
    bucket = _bucket(grid.block_index(F.col("lat_grid")), grid.block_index(F.col("lon_grid")), seed)
    return cells.withColumns(
        {
            "block": grid.block_key(F.col("lat_grid"), F.col("lon_grid")),
            "split": _named(bucket, train, validation),
        }
    )


def cell_split(cells: DataFrame, train: int = 70, validation: int = 15, seed: str = SEED) -> DataFrame:
    """70/15/15 by cell, the older protocol (a cell is one row)."""
    bucket = _bucket(grid.cell_index(F.col("lat_grid")), grid.cell_index(F.col("lon_grid")), seed)
    return cells.withColumn("split", _named(bucket, train, validation))


def development(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") != "test")


def shared_blocks(split: DataFrame) -> DataFrame:
    """Blocks that occur in more than one split (none, if the split is right)."""
    return (
        split.groupBy("block")
        .agg(F.countDistinct("split").alias("splits"))
        .where(F.col("splits") > 1)
    )


def split_summary(split: DataFrame) -> DataFrame:
    """Rows, share and extent per split, and the number of leaking blocks."""
    total = split.agg(F.count(F.lit(1)).alias("n")).scalar()
    leaking = shared_blocks(split).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        split.groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("lat_grid").alias("south"), F.max("lat_grid").alias("north"),
            F.min("lon_grid").alias("west"), F.max("lon_grid").alias("east"),
            *[F.count_if(F.col(TARGET) == c).alias(f"class_{c}") for c in range(4)],
        )
        .withColumns({"share": F.col("rows") / total, "leaking_blocks": leaking})
    )
