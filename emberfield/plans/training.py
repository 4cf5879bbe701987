"""Model definitions, weighted fits, evaluation and experiments."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberfield.constants import (
    BINARY_TARGET,
    CLASSES,
    FEATURE_SETS,
    FINAL_FEATURES,
    MODEL_CLASS_LABELS,
    TARGET,
)
from emberfield.operators import metrics, quality, splits
from emberfield.plans import boosting, forest, isolation, linear
from emberfield.session import materialize, scratch_root

MODEL_NAMES = [
    "logistic_regression",
    "decision_tree",
    "random_forest",
    "hist_gradient_boosting",
    "xgboost",
]
SEED = 42
#: Fits whose Spark jobs run side by side.
PARALLEL_FITS = 4


class Size:
    """How large the models are; the defaults are the published settings."""

    def __init__(self, iterations=300, trees=300, tree_depth=30, leaves=31, boost_depth=6, linear_iterations=1000,
                 binary_iterations=100, isolation_trees=100):
        self.iterations = iterations
        self.trees = trees
        self.tree_depth = tree_depth
        self.leaves = leaves
        self.boost_depth = boost_depth
        self.linear_iterations = linear_iterations
        self.binary_iterations = binary_iterations
        self.isolation_trees = isolation_trees


def prepare_checkpoints(spark: SparkSession) -> None:
    """Let long fits cut their lineage in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def booster(name: str, size: Size = Size()) -> boosting.Settings | None:
    """How a boosted model grows its trees; None for other models."""
    if name == "xgboost":
        return replace(boosting.SOFTPROB, rounds=size.iterations, depth=size.boost_depth, seed=SEED)
    if name == "hist_gradient_boosting":
        return replace(boosting.LEAF_WISE, rounds=size.iterations, leaves=size.leaves, seed=SEED)
    if name == "binary_boosting":
        return replace(boosting.LEAF_WISE, rounds=size.binary_iterations, leaves=size.leaves, rate=0.1, seed=SEED)
    return None


def _training_table(rows: DataFrame, names: list[str], label: str) -> DataFrame:
    # The key decides which rows a boosting round samples: the place, so that it does not depend on partitions.
    key = F.xxhash64("grid_id") if "grid_id" in rows.columns else F.xxhash64(*names)
    base = rows.select(
        F.col(label).cast("double").alias("label"), key.alias("key"), *[F.col(n).cast("double") for n in names]
    )
    return metrics.with_class_weight(base, "label")


def fit_many(
    models: list[str], train: DataFrame, names: list[str] | dict[str, list[str]], size: Size = Size(), label: str = TARGET
) -> dict:
    """Weighted fits on one prepared table: model and wall seconds by name, or by (feature set, name).

    ``names`` is a list of features or several of them by name. The table has the weights and the columns of all
    sets, and stays on the executors while the fits read it. All boosters are fitted together, on the same passes
    over one binned matrix of all columns; the other models are fitted side by side, forests on at most
    ``boosting.TASK_ROWS`` rows of it. The seconds of a booster are those of the common fit.
    """
    prepare_checkpoints(train.sparkSession)
    sets = names if isinstance(names, dict) else {"": names}
    columns = list(dict.fromkeys(c for own in sets.values() for c in own))
    classes = len(CLASSES) if label == TARGET else 2
    table = _training_table(train, columns, label).persist(StorageLevel.MEMORY_AND_DISK)
    boosted = [(s, m) for s in sets for m in models if booster(m)]
    fitted, matrices = {}, []

    def boost() -> None:
        started = time.time()
        found = boosting.fit(matrices[0], [(booster(m, size), sets[s]) for s, m in boosted])
        for (s, m), model in zip(boosted, found):
            keep(s, m, model, started)

    def single(s: str, m: str) -> None:
        started = time.time()
        if m == "logistic_regression":
            model = linear.fit(table, sets[s], classes, size.linear_iterations)
        elif m == "random_forest":
            model = forest.fit(matrices[-1], sets[s], size.trees, size.tree_depth, SEED)
        elif m == "decision_tree":
            tree = DecisionTreeClassifier(maxDepth=size.tree_depth, seed=SEED, labelCol="label", weightCol="weight")
            model = tree.fit(VectorAssembler(inputCols=sets[s], outputCol="features").transform(table))
        else:
            raise ValueError(f"unknown model {m}")
        keep(s, m, model, started)

    def keep(s: str, m: str, model: Transformer, started: float) -> None:
        assembler = VectorAssembler(inputCols=sets[s], outputCol="features")
        fitted[s, m] = PipelineModel([assembler, model]), round(time.time() - started, 2)

    try:
        count = table.count()
        # A forest takes at most so many rows, picked by place; boosters take all.
        share = boosting.TASK_ROWS / max(count, 1)
        sampled = "random_forest" in models and share < 1
        if boosted or ("random_forest" in models and not sampled):
            matrices.append(boosting.binned(table, columns, classes))
        if sampled:
            lot = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1_000_003)) / F.lit(1_000_003)
            matrices.append(boosting.binned(table.where(lot < share * 0.99), columns, classes))
        # The forests leave no core idle, so the boosters, one core each, go first.
        jobs = [boost] if boosted else []
        jobs += [lambda s=s, m=m: single(s, m) for m in models for s in sets if not booster(m)]
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            for job in [pool.submit(inheritable_thread_target(train.sparkSession)(j)) for j in jobs]:
                job.result()
    finally:
        for matrix in matrices:
            matrix.release()
        table.unpersist()
    return fitted if isinstance(names, dict) else {m: fitted["", m] for m in models}


def fit(
    name: str, train: DataFrame, names: list[str], size: Size = Size(), label: str = TARGET
) -> tuple[PipelineModel, float]:
    """Weighted fit; returns the model and the wall time in seconds."""
    return fit_many([name], train, names, size, label)[name]


def class_scores(model: PipelineModel | Transformer) -> Column:
    """Class probabilities as an array, one element per class."""
    return vector_to_array("probability")


def predict(model: PipelineModel, rows: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows with ``label``, ``prediction`` (int), and ``scores`` (array)."""
    scored = model.transform(rows.withColumn("label", F.col(label).cast("int")))
    return scored.withColumns(
        {"scores": class_scores(model), "prediction": F.col("prediction").cast("int")}
    )


def evaluate(name: str, model: PipelineModel, rows: DataFrame, label: str = TARGET) -> DataFrame:
    """Macro F1 and balanced accuracy of a fitted model, as one row."""
    return metrics.summary_metrics(predict(model, rows, label)).select(
        F.lit(name).alias("model"), "macro_f1", "balanced_accuracy"
    )


def _result(experiment, name, names, seconds, model, test) -> DataFrame:
    return evaluate(name, model, test).select(
        F.lit(experiment).alias("experiment"),
        "model",
        F.lit(len(names)).alias("feature_count"),
        "macro_f1",
        "balanced_accuracy",
        F.lit(float(seconds)).alias("training_seconds"),
    )


def run_experiments(
    data: DataFrame,
    feature_sets: list[str],
    models: list[str] = MODEL_NAMES,
    size: Size = Size(),
    held_out: bool = False,
) -> DataFrame:
    """Every model on every feature set, on one shared split by place.

    Fits on train and scores validation; with ``held_out`` fits on train plus
    validation and scores the untouched test split once. The split table is
    persisted while the fits and scores read it. Only metric rows are unioned.
    """
    split = splits.block_split(data).persist(StorageLevel.MEMORY_AND_DISK)
    train = splits.development(split) if held_out else split.where(F.col("split") == "train")
    test = split.where(F.col("split") == ("test" if held_out else "validation"))
    sets = {experiment: FEATURE_SETS[experiment] for experiment in feature_sets}
    for names in sets.values():
        quality.require_clean(split, names)
    fitted = fit_many(models, train, sets, size)
    rows = [
        _result(experiment, name, names, fitted[experiment, name][1], fitted[experiment, name][0], test)
        for experiment, names in sets.items() for name in models
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    # A few metric rows; with them written the split table can go.
    out = materialize(out, "results")
    split.unpersist()
    return out


def feature_importances(model: PipelineModel, names: list[str], spark: SparkSession) -> DataFrame:
    """Importance per feature, and its share in percent."""
    values = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
    return metrics.importance_shares(rows)


def compare_importance(data: DataFrame, size: Size = Size()) -> DataFrame:
    """Importances without and with context, side by side, by feature."""
    dev = splits.development(splits.block_split(data))
    sets = {experiment: FEATURE_SETS[experiment] for experiment in ("reduced", "reduced_context")}
    fitted = fit_many(["xgboost"], dev, sets, size)
    tables = {e: feature_importances(fitted[e, "xgboost"][0], names, data.sparkSession) for e, names in sets.items()}
    return metrics.compare_importances(tables["reduced_context"], tables["reduced"])


def train_final(cells: DataFrame, size: Size = Size()) -> tuple[PipelineModel, DataFrame]:
    """The final ten-feature model on train plus validation, and its metadata row."""
    checked = quality.require_clean(quality.feature_matrix(cells, "final"), FINAL_FEATURES)
    split = splits.block_split(checked).persist(StorageLevel.MEMORY_AND_DISK)
    model, seconds = fit("xgboost", splits.development(split), FINAL_FEATURES, size)
    numbers = split.agg(
        F.count_if(F.col("split") != "test").alias("train_plus_validation_rows"),
        F.count_if(F.col("split") == "test").alias("untouched_test_rows"),
    )
    rows = numbers.select(F.struct("*").alias("rows")).scalar()
    scores = evaluate("xgboost", model, split.where(F.col("split") == "test"))
    metadata = scores.select(
        F.lit("boosted-leakage-reduced-v1").alias("model_version"),
        F.lit(TARGET).alias("target"),
        F.array(*[F.lit(n) for n in FINAL_FEATURES]).alias("feature_names"),
        F.create_map(
            *[x for k, t in MODEL_CLASS_LABELS.items() for x in (F.lit(k), F.lit(t))]
        ).alias("class_mapping"),
        rows["train_plus_validation_rows"].alias("train_plus_validation_rows"),
        rows["untouched_test_rows"].alias("untouched_test_rows"),
        F.col("macro_f1").alias("test_macro_f1"),
        F.col("balanced_accuracy").alias("test_balanced_accuracy"),
        F.lit(float(seconds)).alias("training_seconds"),
        F.lit("heuristic_weak_labels").alias("label_status"),
    )
    return model, metadata


def save_artifact(model: PipelineModel, metadata: DataFrame, path: str) -> None:
    """Model and its contract (features, class texts, version) under one folder."""
    model.save(f"{path}/model")
    metadata.write.parquet(f"{path}/metadata")


def load_artifact(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    row = spark.read.parquet(f"{path}/metadata").first()
    if not row["feature_names"]:
        raise ValueError("artifact has no feature names")
    return PipelineModel.load(f"{path}/model"), row.asDict()


def binary_baseline(cells: DataFrame, size: Size = Size(trees=100, tree_depth=12)) -> DataFrame:
    """Logistic regression, forest, boosting and isolation forest on the binary label."""
    names = FEATURE_SETS["full_context"]
    split = splits.cell_split(quality.require_clean(cells, names)).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")

    def row(name: str, predictions: DataFrame) -> DataFrame:
        # Two reports read the predictions; the model runs over them once.
        scored = materialize(predictions, "predictions")
        curves = metrics.area_under_curves(scored).select(F.struct("*").alias("c")).scalar()
        return metrics.binary_metrics(scored).select(
            F.lit(name).alias("model"),
            "*",
            curves["roc_auc"].alias("roc_auc"),
            curves["pr_auc"].alias("pr_auc"),
        )

    out = None
    supervised = ["logistic_regression", "random_forest", "binary_boosting"]
    for name, (model, _) in fit_many(supervised, train, names, size, BINARY_TARGET).items():
        scored = predict(model, test, BINARY_TARGET).withColumn("score", F.element_at("scores", 2))
        one = row(name, scored.select("label", "prediction", "score"))
        out = one if out is None else out.unionByName(one)

    trees = isolation.fit_forest(train, names, trees=size.isolation_trees)
    scored = isolation.score(trees, test, names)
    cut = isolation.threshold(isolation.score(trees, train, names), contamination=0.015)
    flagged = scored.select(
        F.col(BINARY_TARGET).alias("label"),
        F.col("anomaly_score").alias("score"),
        (F.col("anomaly_score") > cut).cast("int").alias("prediction"),
    )
    return out.unionByName(row("isolation_forest", flagged))


def binary_importances(cells: DataFrame, size: Size = Size(trees=100, tree_depth=12)) -> DataFrame:
    """Importances of the baseline's forest, with shares in percent."""
    names = FEATURE_SETS["full_context"]
    train = splits.cell_split(quality.require_clean(cells, names)).where(F.col("split") == "train")
    model, _ = fit("random_forest", train, names, size, BINARY_TARGET)
    return feature_importances(model, names, cells.sparkSession)
