"""Boosters, forests and the regression against plain computations."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from emberfield.plans import boosting as B, forest, linear

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 4)).round(2)
    label = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] + x[:, 2] > 0.3)
    label = np.where(rng.random(1500) < 0.08, rng.integers(0, 4, 1500), label)
    return pd.DataFrame(x, columns=NAMES).assign(label=label.astype(float), weight=rng.uniform(0.5, 2, 1500), key=rng.integers(-(2**62), 2**62, 1500))


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows).cache()


def _trees(model):
    return B._unpacked(model.getOrDefault("trees"))


def test_passes_by_spark_and_inside_a_task_give_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 300)
    matrix = B.binned(table, NAMES, 4)
    wanted = [(replace(B.SOFTPROB, rounds=3), NAMES), (replace(B.LEAF_WISE, rounds=3, leaves=7, stop_above=100), ["b", "d"])]
    one = B.fit(matrix, wanted)
    monkeypatch.setattr(B, "DIRECT_TASKS", 2)
    two = B.fit(matrix, wanted, task_rows=0)
    for a, b in zip(one, two):
        a, b = _trees(a), _trees(b)
        assert len(a["feature"]) > 20 and np.array_equal(a["feature"], b["feature"])
        assert np.allclose(a["threshold"], b["threshold"]) and np.allclose(a["value"], b["value"])
    matrix.release()


def test_first_split_has_the_best_gain(table, rows):
    matrix = B.binned(table, NAMES, 4)
    settings = replace(B.SOFTPROB, rounds=1, depth=1, row_share=1.0, column_share=1.0)
    model = _trees(B.fit(matrix, [(settings, NAMES)])[0])
    for k in range(4):
        y, w = (rows["label"] == k).to_numpy(), rows["weight"].to_numpy()
        g, h = w * (0.25 - y), 2 * w * 0.25 * 0.75
        best = max(
            (sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (rows[n] <= cut, rows[n] > cut)) - g.sum() ** 2 / (h.sum() + 1), n, cut)
            for n, cuts in zip(NAMES, matrix.cuts) for cut in cuts
            if h[rows[n] <= cut].sum() >= 1 and h[rows[n] > cut].sum() >= 1
        )
        at = 3 * k
        assert model["gain"][at] == pytest.approx(best[0]) and NAMES[model["feature"][at]] == best[1] and model["threshold"][at] == pytest.approx(best[2])
        left = rows[best[1]] <= best[2]
        assert model["value"][at + 1] == pytest.approx(-0.08 * g[left].sum() / (h[left].sum() + 1))


def test_leaf_wise_trees_have_at_most_31_leaves_and_stop_early(spark, table):
    matrix = B.binned(table, NAMES, 4)
    long, short = B.fit(matrix, [(replace(B.LEAF_WISE, rounds=60), NAMES), (replace(B.LEAF_WISE, rounds=300, rate=0.5, stop_above=1000), NAMES)])
    # 1500 rows are no large table: all rounds are fitted there.
    assert long.rounds == 60 and 25 < max(long.leaf_counts) <= 31
    assert short.rounds < 100
    assert B._stalled([3, 2, 1] + [1.5] * 10, B.LEAF_WISE) and not B._stalled([3, 2, 1] + [1.5] * 9, B.LEAF_WISE)
    empty = B.binned(table.limit(0), NAMES, 4)
    (none,) = B.fit(empty, [(replace(B.SOFTPROB, rounds=2), NAMES)])
    scored = none.transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(table.limit(3)))
    assert scored.select(F.sum("prediction")).first()[0] in (0.0, 3.0, 6.0, 9.0)


def test_forest_learns_and_does_not_depend_on_partitions(table, rows):
    models = []
    for part in (table, table.repartition(5)):
        matrix = B.binned(part, NAMES, 4)
        models.append(forest.fit(matrix, NAMES, 12, 30, 42))
    a, b = (forest._unpacked(m.getOrDefault("trees")) for m in models)
    assert np.array_equal(a["feature"], b["feature"]) and np.allclose(a["threshold"], b["threshold"])
    scored = models[0].transform(VectorAssembler(inputCols=NAMES, outputCol="features").transform(table))
    assert scored.where("label = prediction").count() > 1400
    shares = models[0].featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares.argmin() == 3


def test_regression_is_at_the_optimum(table, rows):
    model = linear.fit(table, NAMES, 4)
    import json

    fitted = {k: np.array(v) for k, v in json.loads(model.getOrDefault("weights")).items()}
    x = np.hstack([np.ones((1500, 1)), (rows[NAMES].to_numpy() - fitted["mean"]) / fitted["scale"]])
    p = linear._probabilities(x, fitted["beta"])
    p[np.arange(1500), rows["label"].astype(int)] -= 1
    gradient = (p * rows["weight"].to_numpy()[:, None]).T @ x
    gradient[:, 1:] += fitted["beta"][:, 1:]
    assert np.abs(gradient).max() < 1e-3
