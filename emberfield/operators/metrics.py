"""Classification metrics from a table of (label, prediction[, score])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberfield.constants import CLASSES
from emberfield.functions.ordered import running_totals, with_share


def _matrix_row(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """All counts of the fixed confusion matrix as columns ``m<i>_<j>``.

    Sixteen conditional counts in one aggregate: the rows combine on the map
    side and absent classes come out as 0 without a join.
    """
    cells = [
        F.count_if((F.col(label) == i) & (F.col(prediction) == j)).alias(f"m{i}_{j}")
        for i in CLASSES
        for j in CLASSES
    ]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label class, one column per predicted class."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("label"), *[F.col(f"m{i}_{j}").alias(f"pred_{j}") for j in CLASSES])
            for i in CLASSES
        ]
    )
    return _matrix_row(df, label, prediction).select(F.inline(rows))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _class_numbers(i: int) -> dict[str, Column]:
    hit = F.col(f"m{i}_{i}")
    support = sum((F.col(f"m{i}_{j}") for j in CLASSES[1:]), F.col(f"m{i}_0"))
    predicted = sum((F.col(f"m{j}_{i}") for j in CLASSES[1:]), F.col(f"m0_{i}"))
    return {
        "precision": _ratio(hit, predicted),
        "recall": _ratio(hit, support),
        "f1": _ratio(hit * F.lit(2), support + predicted),
        "support": support,
        "predicted": predicted,
    }


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; an empty division gives 0."""
    rows = []
    for i in CLASSES:
        n = _class_numbers(i)
        rows.append(
            F.struct(
                F.lit(i).alias("label"),
                n["precision"].alias("precision"),
                n["recall"].alias("recall"),
                n["f1"].alias("f1"),
                n["support"].alias("support"),
            )
        )
    return _matrix_row(df, label, prediction).select(F.inline(F.array(*rows)))


def summary_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Macro F1 over classes seen anywhere, balanced accuracy over labelled ones."""
    f1_sum = recall_sum = seen = labelled = F.lit(0.0)
    for i in CLASSES:
        n = _class_numbers(i)
        is_seen = (n["support"] + n["predicted"] > 0).cast("double")
        is_labelled = (n["support"] > 0).cast("double")
        f1_sum, seen = f1_sum + n["f1"] * is_seen, seen + is_seen
        recall_sum, labelled = recall_sum + n["recall"] * is_labelled, labelled + is_labelled
    return _matrix_row(df, label, prediction, by).select(
        *(by or []),
        _ratio(f1_sum, seen).alias("macro_f1"),
        _ratio(recall_sum, labelled).alias("balanced_accuracy"),
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1, specificity and the four counts."""
    truth, guess = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(truth & guess).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "tn", "fp", "fn", "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * F.lit(2), tp * F.lit(2) + fp + fn).alias("f1_score"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def area_under_curves(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC and PR-AUC by the trapezoid rule over distinct scores.

    Equal scores fold into one point before the points are ordered, and the
    ordering is done range by range (``running_totals``).
    """
    points = df.groupBy((-F.col(score)).alias("_down")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
    )
    curve = running_totals(points, "_down", ["pos", "neg"])
    tp, fp = F.col("pos_upto").cast("double"), F.col("neg_upto").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    precision = _ratio(tp, tp + fp)
    precision0 = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(_ratio(tp0, tp0 + fp0))
    sums = curve.agg(
        F.sum((fp - fp0) * (tp + tp0) / F.lit(2.0)).alias("roc"),
        F.sum((tp - tp0) * (precision + precision0) / F.lit(2.0)).alias("pr"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    return sums.select(
        F.try_divide(F.col("roc"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"),
        F.try_divide(F.col("pr"), F.col("p").cast("double")).alias("pr_auc"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse-frequency weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).alias("t"))
    total = totals.scalar()
    return counts.withColumn("weight", total["rows"] / (total["k"] * F.col("n")))


def with_class_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Attach the weight of each row's class.

    Counting first and joining the few class rows back keeps a dominant class
    spread over all tasks; a window by class would not. The broadcast has one
    row per class.
    """
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(weights), label)


def pivot_with_delta(results: DataFrame, base: str, other: str) -> DataFrame:
    """Metrics per model for two experiments side by side, with differences."""
    names = ["macro_f1", "balanced_accuracy", "training_seconds"]
    wide = results.groupBy("model").agg(
        *[
            F.max(F.when(F.col("experiment") == e, F.col(m))).alias(f"{m}_{e}")
            for m in names
            for e in (base, other)
        ]
    )
    return wide.withColumns(
        {f"{m}_delta": F.col(f"{m}_{other}") - F.col(f"{m}_{base}") for m in names}
    )


def compare_experiments(results: DataFrame) -> DataFrame:
    """Full, reduced and reduced-with-context results joined by model."""
    def one(experiment: str, prefix: str) -> DataFrame:
        return results.where(F.col("experiment") == experiment).select(
            "model",
            F.col("macro_f1").alias(f"{prefix}_macro_f1"),
            F.col("balanced_accuracy").alias(f"{prefix}_balanced_accuracy"),
        )

    joined = (
        one("full", "full")
        .join(one("reduced", "reduced"), "model")
        .join(one("reduced_context", "reduced_osm"), "model")
    )
    minus = lambda a, b: F.col(a) - F.col(b)
    return joined.withColumns(
        {
            "macro_f1_change_after_leakage_reduction": minus("reduced_macro_f1", "full_macro_f1"),
            "balanced_accuracy_change_after_leakage_reduction": minus(
                "reduced_balanced_accuracy", "full_balanced_accuracy"
            ),
            "macro_f1_osm_delta": minus("reduced_osm_macro_f1", "reduced_macro_f1"),
            "balanced_accuracy_osm_delta": minus(
                "reduced_osm_balanced_accuracy", "reduced_balanced_accuracy"
            ),
        }
    )


def importance_shares(importances: DataFrame) -> DataFrame:
    """Importance in percent of the total (0 when the total is 0)."""
    shared = with_share(importances.withColumn("_v", F.nullif(F.col("importance"), F.lit(0.0))), "_v", "_s")
    return shared.withColumn(
        "importance_percent", F.coalesce(F.col("_s") * F.lit(100.0), F.lit(0.0))
    ).drop("_v", "_s")


def compare_importances(with_context: DataFrame, without: DataFrame) -> DataFrame:
    """Importances of two feature sets by feature; NULL where one lacks it."""
    keep = ["feature", "importance", "importance_percent"]
    left = with_context.select("feature", *[F.col(c).alias(f"{c}_osm") for c in keep[1:]])
    right = without.select("feature", *[F.col(c).alias(f"{c}_detections") for c in keep[1:]])
    return left.join(right, "feature", "left")


def ranked(results: DataFrame, by: str, tie: str, limit: int | None = None) -> DataFrame:
    ordered = results.orderBy(F.desc(by), tie)
    return ordered.limit(limit) if limit else ordered
