"""Training, evaluation and scoring on the derived cells (small models)."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from emberfield.catalog import registry as r
from emberfield.catalog.registry import query, rounded
from emberfield.constants import (
    BINARY_TARGET,
    CONTEXT_UNAVAILABLE_EVIDENCE,
    DETECTION_FEATURES,
    FEATURE_SETS,
    FINAL_FEATURES,
    MODEL_CLASS_LABELS,
    NO_MODEL_EVIDENCE,
    SCORE_NOTE,
)
from emberfield.operators import metrics, splits
from emberfield.plans import isolation, scoring, training
from emberfield.session import materialize, scratch_path


def _split(spark, folder):
    # Written once: training reads it many times, and a lost executor must not
    # send it back to the detections.
    return materialize(splits.block_split(r.labelled_cells(spark, folder)), "split")


@query(
    "m4_standard_scaling",
    "SELECT split, "
    + ", ".join(
        f"round((avg({c}) - (SELECT avg({c}) FROM {{spl}} WHERE split='train'))"
        f" / (SELECT stddev_samp({c}) FROM {{spl}} WHERE split='train'), 6) + 0.0::double AS mean_{c}"
        for c in DETECTION_FEATURES
    )
    + " FROM {spl} GROUP BY split",
)
def m4(spark, folder):
    table = _split(spark, folder)
    packed = VectorAssembler(inputCols=DETECTION_FEATURES, outputCol="features").transform(table)
    train = packed.where(F.col("split") == "train")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(train)
    values = scaler.transform(packed).withColumn("v", vector_to_array("scaled"))
    return values.groupBy("split").agg(
        *[(F.round(F.avg(F.col("v")[i]), 6) + F.lit(0.0)).alias(f"mean_{n}") for i, n in enumerate(DETECTION_FEATURES)]
    )


# What a fit finds depends on its arithmetic, so a query returns what must hold whatever the model found: rows, supports,
# names, counts, and whether the scores are in range and better than naming the largest class. The scores
# themselves are what `training.run_experiments` and its neighbours return.


def _one_model(name):
    def run(spark, folder):
        table = _split(spark, folder)
        model, _ = training.fit(name, table.where(F.col("split") == "train"), DETECTION_FEATURES)
        scored = materialize(training.predict(model, table.where(F.col("split") == "validation")).select("label", "prediction"), "scored")
        classes = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        numbers = classes.agg(
            F.struct(F.sum("n").alias("rows"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("classes")).alias("c")
        ).scalar()
        # Macro F1 of naming the largest class for every row.
        guess = F.lit(2.0) * numbers["largest"] / (numbers["largest"] + numbers["rows"]) / numbers["classes"]
        return metrics.summary_metrics(scored).select(
            F.lit(name).alias("model"), numbers["rows"].alias("rows"), numbers["largest"].alias("majority_rows"),
            (F.col("macro_f1") > guess).alias("beats_majority"),
        )

    return run


for _key, _name in (
    ("m5_logistic_regression", "logistic_regression"),
    ("m6_decision_tree", "decision_tree"),
    ("m7_random_forest", "random_forest"),
    ("m8_histogram_boosting", "hist_gradient_boosting"),
    ("m9_softprob_boosting", "xgboost"),
):
    query(
        _key,
        f"SELECT '{_name}' AS model, CAST(sum(n) AS BIGINT) AS rows, max(n) AS majority_rows, true AS beats_majority"
        " FROM (SELECT count(*) AS n FROM {spl} WHERE split = 'validation' GROUP BY target_multiclass)",
    )(_one_model(_name))


def _sides(scored):
    """Labelled negatives and positives of binary counts, and whether the scores are in range."""
    fair = F.lit(True)
    for name in ("accuracy", "precision", "recall", "f1_score", "specificity"):
        fair = fair & F.col(name).between(0, 1)
    return [(F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"), fair.alias("in_range")]


_SIDES = (
    "count(*) FILTER (WHERE target_persistent_source = 0) AS negatives,"
    " count(*) FILTER (WHERE target_persistent_source = 1) AS positives, true AS in_range"
)


@query("m10_isolation_forest", f"SELECT {_SIDES} FROM {{spl}} WHERE split = 'test'")
def m10(spark, folder):
    table = _split(spark, folder)
    train = table.where(F.col("split") == "train")
    forest = isolation.fit_forest(train, DETECTION_FEATURES, trees=100)
    cut = isolation.threshold(isolation.score(forest, train, DETECTION_FEATURES))
    scored = isolation.score(forest, table.where(F.col("split") == "test"), DETECTION_FEATURES)
    counts = metrics.binary_metrics(
        scored.select(
            F.col(BINARY_TARGET).alias("label"), (F.col("anomaly_score") > cut).cast("int").alias("prediction")
        )
    )
    return counts.select(*_sides(counts))


@query(
    "m11_weighted_training_table",
    "SELECT grid_id, label, round((SELECT count(*) FROM {pred})/(4*(SELECT count(*) FROM {pred} x WHERE x.label=p.label))::double, 6) AS weight"
    " FROM {pred} p",
)
def m11(spark, folder):
    rows = r.rule_predictions(spark, folder).select("grid_id", "label")
    return rounded(metrics.with_class_weight(rows).select("grid_id", "label", "weight"), "weight")


@query(
    "m12_evaluate_on_split",
    "SELECT k AS label, (SELECT count(*) FROM {spl} WHERE split = 'validation' AND target_multiclass = k) AS support, true AS rows_add_up"
    " FROM (VALUES (0), (1), (2), (3)) v(k)",
)
def m12(spark, folder):
    table = _split(spark, folder)
    model, _ = training.fit("decision_tree", table.where(F.col("split") == "train"), DETECTION_FEATURES)
    validation = table.where(F.col("split") == "validation")
    scored = materialize(training.predict(model, validation).select("label", "prediction"), "scored")
    report, matrix = metrics.class_report(scored), metrics.confusion_matrix(scored)
    row = F.col("pred_0") + F.col("pred_1") + F.col("pred_2") + F.col("pred_3")
    return report.join(matrix, "label").select("label", "support", (row == F.col("support")).alias("rows_add_up"))


_MODELS_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in training.MODEL_NAMES) + ") m(model)"


def _fair(*columns):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).between(0, 1)
    return out.alias("in_range")


@query("m13_benchmark_models", f"SELECT model, CAST({len(FEATURE_SETS['full'])} AS INT) AS feature_count, true AS in_range FROM {_MODELS_SQL}")
def m13(spark, folder):
    table = materialize(r.labelled_cells(spark, folder), "cells")
    ranked = metrics.ranked(training.run_experiments(table, ["full"]), "macro_f1", "model")
    return ranked.select("model", "feature_count", _fair("macro_f1", "balanced_accuracy"))


def _matched(spark, folder):
    return materialize(r.matched(spark, folder), "matched")


@query("m14_ablation", f"SELECT model, true AS in_range FROM {_MODELS_SQL}")
def m14(spark, folder):
    results = training.run_experiments(
        _matched(spark, folder), ["full", "reduced", "reduced_context"]
    )
    return metrics.compare_experiments(results).select(
        "model", _fair(*[f"{p}_{n}" for p in ("full", "reduced", "reduced_osm") for n in ("macro_f1", "balanced_accuracy")])
    )


@query("m15_context_comparison", f"SELECT model, true AS in_range FROM {_MODELS_SQL}")
def m15(spark, folder):
    results = training.run_experiments(_matched(spark, folder), ["full", "full_context"])
    wide = metrics.pivot_with_delta(results, "full", "full_context")
    return wide.select("model", _fair(*[f"{n}_{e}" for n in ("macro_f1", "balanced_accuracy") for e in ("full", "full_context")]))


@query(
    "m16_held_out_test",
    "SELECT experiment, model, CAST(n AS INT) AS feature_count, true AS in_range FROM (VALUES "
    + ", ".join(f"('{e}', {len(FEATURE_SETS[e])})" for e in ("full", "reduced", "reduced_context"))
    + f") e(experiment, n) CROSS JOIN {_MODELS_SQL}",
)
def m16(spark, folder):
    results = training.run_experiments(
        _matched(spark, folder), ["full", "reduced", "reduced_context"],
        held_out=True,
    )
    return results.select("experiment", "model", "feature_count", _fair("macro_f1", "balanced_accuracy"))


@query(
    "m17_final_model",
    "SELECT 'target_multiclass' AS target, count(*) FILTER (WHERE split <> 'test') AS train_plus_validation_rows,"
    " count(*) FILTER (WHERE split = 'test') AS untouched_test_rows, true AS in_range FROM {spl}",
)
def m17(spark, folder):
    _, metadata = training.train_final(materialize(r.labelled_cells(spark, folder), "cells"))
    return metadata.select(
        "target", "train_plus_validation_rows", "untouched_test_rows", _fair("test_macro_f1", "test_balanced_accuracy")
    )


@query(
    "m18_feature_importance",
    "SELECT feature, own AS without_context, 100.0::double AS total_percent FROM (VALUES "
    + ", ".join(f"('{n}', {str(n in FEATURE_SETS['reduced']).lower()})" for n in FEATURE_SETS["reduced_context"])
    + ") f(feature, own)",
)
def m18(spark, folder):
    shares = materialize(training.compare_importance(_matched(spark, folder)), "importances")
    total = shares.agg(F.round(F.sum("importance_percent_osm"), 6).alias("t")).scalar()
    return shares.select("feature", F.col("importance_detections").isNotNull().alias("without_context"), total.alias("total_percent"))


def _final(spark, folder):
    table = materialize(r.cells_with_context(r.stored_cells(spark, folder), folder), "cells")
    model, metadata = training.train_final(table)
    return table, model, metadata


@query(
    "m19_batch_scoring",
    "SELECT CASE WHEN active_days > 1 THEN 'scored' ELSE 'Missing required model features: max_frp' END AS outcome, count(*) AS n"
    " FROM {cells} GROUP BY 1",
)
def m19(spark, folder):
    table, model, _ = _final(spark, folder)
    # Single-day cells lose a feature, so that the contract has rows to reject.
    broken = table.withColumn("max_frp", F.when(F.col("active_days") > 1, F.col("max_frp")))
    scored, rejected = scoring.score_events(model, broken, FINAL_FEATURES, "boosted-v1")
    named = F.when(F.col("classification").isin(list(MODEL_CLASS_LABELS.values())) & F.col("model_score").between(0, 1), "scored")
    outcomes = scored.select(F.coalesce(named, F.lit("unknown class")).alias("outcome")).unionByName(rejected.select(F.col("rejected").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k5_model_artifact",
    "SELECT 'boosted-leakage-reduced-v1' AS model_version, count(*) AS rows, count(*) AS same_class, count(*) AS same_score"
    " FROM {cells}",
)
def k5(spark, folder):
    table, model, metadata = _final(spark, folder)
    path = scratch_path(spark, "artifact")
    training.save_artifact(model, metadata, path)
    loaded, contract = training.load_artifact(spark, path)

    def scored(which, suffix):
        rows, _ = scoring.score_events(which, table, contract["feature_names"], contract["model_version"], contract["class_mapping"])
        return rows.select("grid_id", "model_version", F.col("predicted_class").alias(f"class_{suffix}"), F.col("model_score").alias(f"score_{suffix}"))

    both = scored(loaded, "a").join(scored(model, "b").drop("model_version"), "grid_id")
    return both.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("class_a") == F.col("class_b")).alias("same_class"),
        F.count_if(F.col("score_a") == F.col("score_b")).alias("same_score"),
    )


_MODEL_TEXT = " ".join(f"WHEN {k} THEN '{t}'" for k, t in MODEL_CLASS_LABELS.items())


@query(
    "m20_evidence",
    f"""SELECT c.grid_id, concat_ws(chr(10),
        'Model classification: ' || (CASE prediction {_MODEL_TEXT} END) || '.',
        'Predicted-class model score: ' || printf('%.4f', score) || '. {SCORE_NOTE}',
        'Days with detections: ' || active_days || '.', 'Days between first and last detection: ' || persistence_days || '.',
        'Number of detections: ' || observation_count || '.',
        CASE WHEN osm_context_available THEN 'Industrial map objects nearby: ' || osm_industrial_count || '.' END,
        CASE WHEN NOT osm_context_available THEN '{CONTEXT_UNAVAILABLE_EVIDENCE}' END) AS explanation_summary
      FROM {{pred}} c JOIN {{assembled}} a USING (grid_id)""",
)
def m20(spark, folder):
    table = r.stored_cells(spark, folder)
    rows = r.with_rule(table).select(
        "grid_id", "prediction", F.col("score").alias("model_score"), "active_days", "persistence_days",
        "observation_count",
    )
    context = r.assembled(table, folder).select("grid_id", "osm_context_available", "osm_industrial_count")
    return scoring.describe_predictions(rows.join(context, "grid_id"), "rule").select(
        "grid_id", "explanation_summary"
    )


@query(
    "m21_no_model_result",
    f"SELECT grid_id, 'MODEL_NOT_AVAILABLE' AS classification, CAST(NULL AS DOUBLE) AS model_score,"
    f" '{NO_MODEL_EVIDENCE}' AS explanation_summary, 'mock-v0' AS model_version, true AS is_mock FROM {{cells}}",
)
def m21(spark, folder):
    return scoring.without_model(r.labelled_cells(spark, folder)).select(
        "grid_id", "classification", "model_score", "explanation_summary", "model_version", "is_mock"
    )


_BASELINE_SQL = f"""SELECT model, negatives, positives, in_range FROM (VALUES ('logistic_regression'), ('random_forest'), ('binary_boosting'), ('isolation_forest')) m(model),
    (SELECT {_SIDES} FROM (SELECT c.target_persistent_source, CAST('0x' || substr(md5(concat_ws('|', 'emberfield',
        CAST(round_even(c.lat_grid/0.01::double,0) AS BIGINT), CAST(round_even(c.lon_grid/0.01::double,0) AS BIGINT))), 1, 8) AS BIGINT) % 100 AS h
        FROM {{cells}} c JOIN {{ctx}} x USING (grid_id)) WHERE h >= 85)"""


@query("m22_binary_baseline", _BASELINE_SQL)
def m22(spark, folder):
    results = training.binary_baseline(_matched(spark, folder))
    return results.select("model", *_sides(results))


@query(
    "m22_forest_importances",
    "SELECT feature, 100.0::double AS total_percent FROM (VALUES "
    + ", ".join(f"('{n}')" for n in FEATURE_SETS["full_context"])
    + ") f(feature)",
)
def m22_importances(spark, folder):
    shares = materialize(training.binary_importances(_matched(spark, folder)), "importances")
    return shares.select("feature", shares.agg(F.round(F.sum("importance_percent"), 6).alias("t")).scalar().alias("total_percent"))


@query("m23_baseline_summary", _BASELINE_SQL)
def m23(spark, folder):
    results = materialize(training.binary_baseline(_matched(spark, folder)), "baseline")
    ranked = metrics.ranked(results, "f1_score", "model")
    return ranked.select("model", *_sides(ranked))
