"""Isolation forest: trees built per group in Python, scored in Arrow batches."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.functions.ordered import exact_quantiles

_SAMPLE = 256
_TREE = "tree int, nodes string"


def _average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma
    long = 2.0 * harmonic - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append the subtree of ``points``; a node is [feature, cut, left, right, size]."""
    here = len(nodes)
    nodes.append([-1, 0.0, -1, -1, len(points)])
    low, high = points.min(axis=0), points.max(axis=0)
    usable = np.flatnonzero(high > low)
    if depth >= limit or len(points) <= 1 or not len(usable):
        return here
    feature = int(rng.choice(usable))
    cut = float(rng.uniform(low[feature], high[feature]))
    goes_left = points[:, feature] <= cut
    left = _grow(points[goes_left], rng, depth + 1, limit, nodes)
    right = _grow(points[~goes_left], rng, depth + 1, limit, nodes)
    nodes[here][:4] = [feature, cut, left, right]
    return here


def fit_forest(train: DataFrame, names: list[str], trees: int = 100, seed: int = 42) -> list[list]:
    """Build ``trees`` trees, each from at most 256 rows picked by hash.

    Each tree's group is bounded by the sample size, so a Python task never
    holds more than 256 rows. What comes back is at most 511 nodes per tree.
    """
    rows = max(train.count(), 1)
    # Thin the table to about twice the wanted rows per tree, then cut exactly.
    share = min(1.0, 2.0 * _SAMPLE / rows)
    key = F.xxhash64("grid_id")
    lot = lambda t: F.pmod(F.xxhash64(key, t, F.lit(seed)), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    picked = (
        train.select("grid_id", *[F.col(n).cast("double") for n in names])
        .withColumn(
            "tree",
            F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: lot(t) < share)),
        )
        .withColumn("_lot", lot(F.col("tree")))
    )
    order = Window.partitionBy("tree").orderBy("_lot", "grid_id")
    sample = picked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= _SAMPLE)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("grid_id")
        points = ordered[names].to_numpy(dtype=float)
        nodes: list = []
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        _grow(points, np.random.default_rng([seed, tree]), 0, limit, nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(nodes)]})

    built = sample.select("tree", "grid_id", *names).groupBy("tree").applyInPandas(build, _TREE)
    return [json.loads(r["nodes"]) for r in built.orderBy("tree").collect()]


def score(forest: list[list], rows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``anomaly_score`` in (0, 1]; higher is more isolated."""
    shared = rows.sparkSession.sparkContext.broadcast(
        [np.array(nodes, dtype=float) for nodes in forest]
    )
    size = max(nodes[0][4] for nodes in forest)

    @F.pandas_udf("double")
    def anomaly(features: pd.Series) -> pd.Series:
        points = np.array(features.tolist(), dtype=float).reshape(-1, len(names))
        total = np.zeros(len(points))
        for nodes in shared.value:
            at = np.zeros(len(points), dtype=int)
            depth = np.zeros(len(points))
            while True:
                inner = nodes[at, 0] >= 0
                if not inner.any():
                    break
                where = at[inner]
                left = points[inner, nodes[where, 0].astype(int)] <= nodes[where, 1]
                at[inner] = np.where(left, nodes[where, 2], nodes[where, 3]).astype(int)
                depth[inner] += 1
            total += depth + _average_path(nodes[at, 4])
        mean = total / max(len(shared.value), 1)
        return pd.Series(np.exp2(-mean / max(float(_average_path(size)), 1e-12)))

    return rows.withColumn("anomaly_score", anomaly(F.array(*[F.col(n).cast("double") for n in names])))


def threshold(scored_train: DataFrame, contamination: float = 0.015) -> Column:
    """Score above which the given share of the training rows lies."""
    cut = exact_quantiles(scored_train, {"anomaly_score": [1.0 - contamination]})
    return cut.select("value").scalar()
