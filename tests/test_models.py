"""Training, contract, scoring, isolation forest, artifacts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.catalog import QUERIES
from emberfield.constants import FEATURE_SETS, FINAL_FEATURES
from emberfield.plans import isolation, scoring, training

#: Small models, for the tests of the functions alone.
SMALL = training.Size(iterations=8, trees=8, tree_depth=6, leaves=8, boost_depth=3, binary_iterations=2)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(800):
        k = i % 4
        x = [float(k * 3 + rng.normal()) for _ in FINAL_FEATURES]
        lat, lon = 10 + (i // 20) * 0.1, 70 + (i % 20) * 0.1
        rows.append((f"g{i}", f"e{i}", lat, lon, k, int(k in (1, 2)), *x))
    ddl = "grid_id string, event_id string, lat_grid double, lon_grid double, target_multiclass int, target_persistent_source int, "
    return spark.createDataFrame(rows, ddl + ", ".join(f"{n} double" for n in FINAL_FEATURES)).cache()


@pytest.mark.parametrize("name", training.MODEL_NAMES)
def test_models_learn_and_give_probabilities(table, name):
    model, seconds = training.fit(name, table, FINAL_FEATURES, SMALL)
    scored = training.predict(model, table)
    right = scored.where("label = prediction").count() / 800
    assert right > 0.9 and seconds >= 0
    row = scored.select(F.size("scores").alias("n"), F.aggregate("scores", F.lit(0.0), lambda a, b: a + b).alias("s")).first()
    assert row["n"] == 4 and row["s"] == pytest.approx(1.0)


def test_contract_artifact_and_score(spark, table, tmp_path):
    model, metadata = training.train_final(table, SMALL)
    training.save_artifact(model, metadata, str(tmp_path / "a"))
    loaded, contract = training.load_artifact(spark, str(tmp_path / "a"))
    assert contract["feature_names"] == FINAL_FEATURES
    first = FINAL_FEATURES[0]
    broken = table.withColumn(
        first,
        F.when(F.col("grid_id") == "g0", F.lit(None))
        .when(F.col("grid_id") == "g1", float("nan"))
        .when(F.col("grid_id") == "g2", float("inf"))
        .otherwise(F.col(first)),
    )
    scored, rejected = scoring.score_events(loaded, broken, FINAL_FEATURES, contract["model_version"], contract["class_mapping"])
    reasons = {r["grid_id"]: r["rejected"] for r in rejected.collect()}
    assert reasons == {
        "g0": f"Missing required model features: {first}",
        "g1": f"Missing required model features: {first}",
        "g2": "Model features must contain only finite numeric values.",
    }
    rows = scored.collect()
    assert len(rows) == 797
    assert all(0 < r["model_score"] <= 1 and r["classification"].endswith("(weak label)") for r in rows)
    # The score is the probability of the predicted class, which is the largest.
    assert min(r["model_score"] for r in rows) >= 0.25


def test_missing_column_is_rejected_by_name(table):
    rows = scoring.check_contract(table.drop("max_frp"), FINAL_FEATURES)
    assert rows.first()["rejected"] == "Missing required model features: max_frp"


def test_evidence_and_labels(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.8, 4, True, 3), ("b", 9, None, None, False, None), ("c", 0, 0.5, 1, None, 7)],
        "grid_id string, prediction int, model_score double, active_days int, osm_context_available boolean, osm_industrial_count int",
    )
    got = {r["grid_id"]: r for r in scoring.describe_predictions(rows, "v").collect()}
    assert got["a"]["evidence"][1].startswith("Predicted-class model score: 0.8000.")
    assert got["a"]["evidence"][-1] == "Industrial map objects nearby: 3."
    assert got["b"]["classification"] == "Class 9"
    assert got["b"]["evidence"][-1].startswith("Map context was not queried")
    assert len(got["c"]["evidence"]) == 3
    none = scoring.without_model(rows).first()
    assert none["classification"] == "MODEL_NOT_AVAILABLE" and none["model_score"] is None and none["is_mock"]


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i}", float(rng.normal()), float(rng.normal())) for i in range(1500)]
    rows += [(f"out{i}", 9.0 + i, -9.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "grid_id string, x double, y double")
    forest = isolation.fit_forest(df, ["x", "y"], trees=50)
    assert len(forest) == 50 and all(nodes[0][4] <= 256 for nodes in forest)
    again = isolation.fit_forest(df.repartition(7), ["x", "y"], trees=50)
    assert again == forest
    scored = isolation.score(forest, df, ["x", "y"]).cache()
    top = {r["grid_id"] for r in scored.orderBy(F.desc("anomaly_score")).limit(10).collect()}
    assert len([g for g in top if g.startswith("out")]) >= 9
    cut = isolation.threshold(scored, 0.1)
    assert scored.where(F.col("anomaly_score") > cut).count() == pytest.approx(151, abs=3)


def test_feature_sets():
    assert [len(FEATURE_SETS[k]) for k in ("full", "reduced", "reduced_context", "full_context", "final")] == [18, 10, 15, 23, 10]
    assert FEATURE_SETS["reduced"] == FEATURE_SETS["final"]


@pytest.mark.parametrize("name", [f"m{i}" for i in (5, 6, 7, 8, 9, 12, 13, 14, 15, 16, 17, 18, 19, 22, 23)] + ["k5"])
def test_registered_queries_train_at_published_sizes(spark, sf_dir, monkeypatch, name):
    class Asked(Exception):
        pass

    def fit_many(models, train, names, size=training.Size(), label=None):
        raise Asked(models, vars(size))

    monkeypatch.setattr(training, "fit_many", fit_many)
    query = next(q for n, q in QUERIES.items() if n.startswith(f"{name}_"))
    with pytest.raises(Asked) as asked:
        query(spark, sf_dir)
    models, size = asked.value.args
    assert size == vars(training.Size(trees=100, tree_depth=12) if name in ("m22", "m23") else training.Size())
    if name in ("m13", "m14", "m15", "m16"):
        assert models == training.MODEL_NAMES
