"""Random forests over the binned matrix: every tree in a task, from a bounded bootstrap sample.

Trees are independent, so Spark deals them to tasks; each task holds the binned rows (a few bytes a feature) and
grows its trees until leaves are pure. A forest is fitted on at most ``boosting.TASK_ROWS`` labelled rows, picked by hash;
the caller samples larger tables. Splits are those with the lowest weighted Gini impurity among the square
root of the features, drawn anew at every node; predictions are the mean of the leaves' class shares.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from emberfield.plans.boosting import Matrix, _unpack

_TREES = "tree int, nodes int, feature binary, bin binary, left binary, value binary, gain binary"


def _grown(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, columns: np.ndarray, classes: int, depth: int,
           rng: np.random.Generator) -> tuple[list, ...]:
    """One tree as lists: feature, last bin that goes left, left child, class shares, impurity decrease."""
    bins = 256
    tries = max(1, int(math.sqrt(len(columns))))
    feature, last, left, value, gain = [-1], [0], [0], [None], [0.0]
    todo = [(0, np.arange(len(label)), 0)]
    while todo:
        node, rows, level = todo.pop()
        own, w = label[rows], weight[rows]
        sums = np.bincount(own, w, classes)
        total = sums.sum()
        value[node] = sums / total if total else np.full(classes, 1 / classes)
        if level >= depth or np.count_nonzero(sums) <= 1:
            continue
        best = (1e-12, -1, 0)
        impurity = total - (sums**2).sum() / total
        # Features that cannot split the node do not count as tries.
        tried = 0
        for column in rng.permutation(columns):
            if tried == tries:
                break
            held = codes[column][rows].astype(np.int64)
            if held.min() == held.max():
                continue
            tried += 1
            below = np.cumsum(np.bincount(held * classes + own, w, bins * classes).reshape(bins, classes), axis=0)
            above = below[-1] - below
            a, b = below.sum(axis=1), above.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                split = (below**2).sum(axis=1) / a + (above**2).sum(axis=1) / b
            decrease = np.where((a > 0) & (b > 0), impurity - total + split, 0.0)
            at = int(decrease.argmax())
            if decrease[at] > best[0]:
                best = (float(decrease[at]), int(column), at)
        if best[1] < 0:
            continue
        first = len(feature)
        feature[node], last[node], left[node], gain[node] = best[1], best[2], first, best[0]
        for column, empty in ((feature, -1), (last, 0), (left, 0), (value, None), (gain, 0.0)):
            column += [empty, empty]
        goes = codes[best[1]][rows] <= best[2]
        todo += [(first, rows[goes], level + 1), (first + 1, rows[~goes], level + 1)]
    return feature, last, left, value, gain


def fit(matrix: Matrix, names: list[str], trees: int, depth: int, seed: int) -> ForestModel:
    """Grow ``trees`` trees on the features ``names`` of a matrix of bounded size."""
    columns = np.array([matrix.names.index(n) for n in names])
    classes, context = matrix.classes, matrix.blocks.sparkSession.sparkContext
    tasks = max(1, min(trees, context.defaultParallelism))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["task"], []).append(row)
        for task, rows in held.items():
            parts = [_unpack(r) for r in rows]
            codes, label, weight, key = (np.concatenate([p[c] for p in parts], axis=-1) for c in ("codes", "label", "weight", "key"))
            # By key, so that a tree does not depend on how rows were dealt.
            order = np.argsort(key, kind="stable")
            codes, label, weight = np.ascontiguousarray(codes[:, order]), label[order].astype(np.int64), weight[order]
            for tree in range(task, trees, tasks):
                rng = np.random.default_rng([seed, tree])
                drawn = np.bincount(rng.integers(0, len(label), len(label)), minlength=len(label))
                picked = np.flatnonzero(drawn)
                grown = _grown(codes[:, picked], label[picked], (drawn * weight)[picked], columns, classes, depth, rng)
                feature, last, left, value, gain = grown
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree], pa.int32()), pa.array([len(feature)], pa.int32())]
                    + [pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in ((feature, np.int16), (last, np.uint8), (left, np.int32), (value, np.float64), (gain, np.float64))],
                    ["tree", "nodes", "feature", "bin", "left", "value", "gain"],
                )

    each = matrix.blocks.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    rows = each.repartitionByRange(tasks, "task").mapInArrow(grow, _TREES).collect()
    place = {int(c): i for i, c in enumerate(columns)}
    sizes, feature, threshold, left, value, gain = [], [], [], [], [], []
    for row in sorted(rows, key=lambda r: r["tree"]):
        own, bins = np.frombuffer(row["feature"], np.int16), np.frombuffer(row["bin"], np.uint8)
        sizes.append(row["nodes"])
        feature.append(np.array([place.get(int(f), -1) for f in own], np.int16))
        threshold.append(np.array([matrix.cuts[f][b] if f >= 0 and b < len(matrix.cuts[f]) else np.inf for f, b in zip(own, bins)]))
        left.append(np.frombuffer(row["left"], np.int32))
        value.append(np.frombuffer(row["value"], np.float64))
        gain.append(np.frombuffer(row["gain"], np.float64))
    parts = {
        "sizes": np.array(sizes, np.int32),
        **{k: np.concatenate(v) if v else np.zeros(0) for k, v in (("feature", feature), ("threshold", threshold), ("left", left), ("value", value), ("gain", gain))},
    }
    text = json.dumps(
        {k: [str(v.dtype), base64.b64encode(v.tobytes()).decode()] for k, v in parts.items()} | {"width": len(names), "classes": classes}
    )
    return ForestModel(trees=text)


def _unpacked(text: str) -> dict:
    return {k: np.frombuffer(base64.b64decode(v[1]), v[0]) if isinstance(v, list) else v for k, v in json.loads(text).items()}


def _shares(model: dict, x: np.ndarray) -> np.ndarray:
    """Mean class shares (rows x classes); NaN goes with the first bin."""
    x = np.where(np.isnan(x), -np.inf, x)
    classes, out, first = model["classes"], np.zeros((len(x), model["classes"])), 0
    for size in model["sizes"]:
        feature, threshold, left = (model[c][first : first + size] for c in ("feature", "threshold", "left"))
        value = model["value"][first * classes : (first + size) * classes].reshape(size, classes)
        first += size
        node = np.zeros(len(x), np.int32)
        active = np.flatnonzero(feature[node] >= 0)
        while len(active):
            own = node[active]
            node[active] = left[own] + (x[active, feature[own]] > threshold[own])
            active = active[feature[node[active]] >= 0]
        out += value[node]
    return out / max(len(model["sizes"]), 1)


class ForestModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted forest: adds ``probability`` (a vector, one element per class) and ``prediction``."""

    trees = Param(Params._dummy(), "trees", "the trees and their thresholds as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees: str | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees)

    @property
    def featureImportances(self):
        """Mean over the trees of a feature's share of the impurity decrease, scaled to sum to 1."""
        model = _unpacked(self.getOrDefault("trees"))
        total, first = np.zeros(model["width"]), 0
        for size in model["sizes"]:
            feature, gain = (model[c][first : first + size] for c in ("feature", "gain"))
            first += size
            own = np.bincount(feature[feature >= 0], gain[feature >= 0], model["width"])
            total += own / own.sum() if own.sum() else own
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = self.getOrDefault("trees")
        held: dict = {}

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            if not held:
                held.update(_unpacked(text))
            return pd.Series(list(_shares(held, np.stack(features.to_numpy()))))

        rows = dataset.withColumn("probability", array_to_vector(probabilities(vector_to_array("features"))))
        best = vector_to_array("probability")
        return rows.withColumn("prediction", (F.array_position(best, F.array_max(best)) - F.lit(1)).cast("double"))
