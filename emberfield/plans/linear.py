"""Multinomial logistic regression by Newton steps.

A pass over the rows sums loss, gradient and Hessian, whose sizes follow from features and classes alone; the driver
solves for the step. The penalised loss is convex, so a dozen passes reach the optimum that first-order methods
approach in hundreds. Features are standardised inside the passes; the penalty is ``C = 1`` on the summed loss.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

#: Newton steps at most, and the relative decrease of the loss that ends them.
MAX_STEPS = 100
TOLERANCE = 1e-10
_SUMS = "sums binary"


def _probabilities(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Class probabilities (rows x classes) of features with a leading 1."""
    scores = x @ beta.T
    scores -= scores.max(axis=1, keepdims=True)
    e = np.exp(scores)
    return e / e.sum(axis=1, keepdims=True)


def fit(table: DataFrame, names: list[str], classes: int, most: int = MAX_STEPS) -> LinearModel:
    """Fit on columns ``names``, ``label`` and ``weight``; at most ``most`` passes."""
    stats = table.agg(
        *[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    ).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(names))])
    scale = np.array([stats[f"s{i}"] or 0.0 for i in range(len(names))])
    scale = np.where(scale > 0, scale, 1.0)
    width = len(names) + 1
    rows = table.select(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)], "label", "weight")

    def summed(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + classes * width + (classes * width) ** 2)
            for batch in batches:
                raw = np.column_stack([batch.column(i).to_numpy() for i in range(len(names))])
                x = np.hstack([np.ones((len(raw), 1)), (raw - mean) / scale])
                y = batch.column(len(names)).to_numpy().astype(int)
                w = batch.column(len(names) + 1).to_numpy()
                p = _probabilities(x, beta)
                loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                off = p.copy()
                off[np.arange(len(y)), y] -= 1
                gradient = (off * w[:, None]).T @ x
                hessian = np.empty((classes, width, classes, width))
                for a in range(classes):
                    for b in range(a, classes):
                        part = w * p[:, a] * ((a == b) - p[:, b])
                        hessian[a, :, b] = (x * part[:, None]).T @ x
                        hessian[b, :, a] = hessian[a, :, b].T
                total += np.concatenate([[loss], gradient.ravel(), hessian.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        # One small row per task; its size does not depend on the data.
        total = np.sum([np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, _SUMS).collect()], axis=0)
        penalty = np.ones((classes, width))
        penalty[:, 0] = 0
        n = classes * width
        loss = total[0] + 0.5 * (penalty * beta**2).sum()
        return loss, total[1 : 1 + n] + (penalty * beta).ravel(), total[1 + n :].reshape(n, n) + np.diag(penalty.ravel())

    beta = np.zeros((classes, width))
    loss, gradient, hessian = summed(beta)
    for _ in range(most):
        # All intercepts may move together without any effect; the least-squares step leaves that direction alone.
        step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0].reshape(beta.shape)
        size, better = 1.0, None
        while size > 1e-4:
            better = summed(beta - size * step)
            if np.isfinite(better[0]) and better[0] <= loss:
                break
            size, better = size / 4, None
        if better is None:
            break
        beta, gain = beta - size * step, loss - better[0]
        loss, gradient, hessian = better
        if gain <= TOLERANCE * max(abs(loss), 1.0):
            break
    return LinearModel(weights=json.dumps({"beta": beta.tolist(), "mean": mean.tolist(), "scale": scale.tolist()}))


class LinearModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted regression: adds ``probability`` (a vector, one element per class) and ``prediction``."""

    weights = Param(Params._dummy(), "weights", "coefficients, means and scales as text", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, weights: str | None = None):
        super().__init__()
        if weights is not None:
            self._set(weights=weights)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = {k: np.array(v) for k, v in json.loads(self.getOrDefault("weights")).items()}

        @F.pandas_udf("array<double>")
        def probabilities(features: pd.Series) -> pd.Series:
            raw = np.stack(features.to_numpy())
            x = np.hstack([np.ones((len(raw), 1)), (raw - model["mean"]) / model["scale"]])
            return pd.Series(list(_probabilities(x, model["beta"])))

        rows = dataset.withColumn("probability", array_to_vector(probabilities(vector_to_array("features"))))
        best = vector_to_array("probability")
        return rows.withColumn("prediction", (F.array_position(best, F.array_max(best)) - F.lit(1)).cast("double"))
