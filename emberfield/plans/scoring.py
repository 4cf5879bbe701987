"""Batch scoring under the model contract, with evidence texts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from emberfield import constants as C
from emberfield.functions import values as v
from emberfield.plans.training import class_scores


def check_contract(rows: DataFrame, names: list[str]) -> DataFrame:
    """Add ``rejected``: why a row cannot be scored, NULL when it can."""
    present = [n for n in names if n in rows.columns]
    number = {n: F.col(n).cast("double") for n in present}
    missing = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(v.is_missing(number[n]), F.lit(True)), F.lit(n))
                if n in number
                else F.lit(n)
                for n in names
            ]
        )
    )
    infinite = F.lit(False)
    for n in present:
        infinite = infinite | F.coalesce(F.abs(number[n]) == F.lit(float("inf")), F.lit(False))
    reason = F.when(
        F.size(missing) > 0,
        F.concat(F.lit("Missing required model features: "), F.array_join(missing, ", ")),
    ).when(infinite, F.lit("Model features must contain only finite numeric values."))
    return rows.withColumn("rejected", reason)


def class_text(prediction: Column, mapping: dict[int, str] = C.MODEL_CLASS_LABELS) -> Column:
    return F.coalesce(
        v.lookup(prediction, mapping), F.concat(F.lit("Class "), prediction.cast("string"))
    )


def evidence(rows: DataFrame, label: Column, score: Column) -> Column:
    """The list of evidence lines of a scored row."""
    def line(name: str, text: str) -> Column:
        value = F.col(name)
        return F.when(
            F.coalesce(~v.is_missing(value.cast("double")), F.lit(False)),
            F.concat(F.lit(f"{text}: "), value.cast("string"), F.lit(".")),
        )

    lines = [F.concat(F.lit("Model classification: "), label, F.lit("."))]
    lines.append(
        F.when(
            score.isNotNull(),
            F.concat(
                F.lit("Predicted-class model score: "),
                F.format_string("%.4f", score),
                F.lit(". " + C.SCORE_NOTE),
            ),
        )
    )
    lines += [line(n, t) for n, t in C.OBSERVED_EVIDENCE if n in rows.columns]
    if "osm_context_available" in rows.columns:
        available = F.col("osm_context_available")
        lines += [F.when(available, line(n, t)) for n, t in C.CONTEXT_EVIDENCE if n in rows.columns]
        lines.append(F.when(~available, F.lit(C.CONTEXT_UNAVAILABLE_EVIDENCE)))
    return F.array_compact(F.array(*lines))


def describe_predictions(
    rows: DataFrame, version: str, mapping: dict[int, str] = C.MODEL_CLASS_LABELS
) -> DataFrame:
    """From ``prediction`` and ``model_score`` to the full response columns."""
    label, score = class_text(F.col("prediction"), mapping), F.col("model_score")
    lines = evidence(rows, label, score)
    return rows.select(
        *[c for c in ("event_id",) if c in rows.columns],
        "grid_id",
        label.alias("classification"),
        F.col("prediction").alias("predicted_class"),
        score.alias("confidence_score"),
        score.alias("model_score"),
        label.alias("classification_label"),
        lines.alias("evidence"),
        F.array_join(lines, "\n").alias("explanation_summary"),
        F.lit(version).alias("model_version"),
        F.lit(False).alias("is_mock"),
    )


def score_events(
    model: PipelineModel, rows: DataFrame, names: list[str], version: str, mapping=C.MODEL_CLASS_LABELS
) -> tuple[DataFrame, DataFrame]:
    """Predictions of the valid rows, and the rejected rows with their reason."""
    checked = check_contract(rows, names)
    valid = checked.where(F.col("rejected").isNull()).drop("rejected")
    numeric = valid.select(
        "*", *[F.col(n).cast("double").alias(f"_x_{n}") for n in names]
    )
    # The pipeline reads its own feature names; keep the originals for evidence.
    kept = [c for c in valid.columns if c in names]
    renamed = numeric.withColumnsRenamed({n: f"_o_{n}" for n in kept}).withColumnsRenamed(
        {f"_x_{n}": n for n in names}
    )
    scored = model.transform(renamed)
    picked = F.element_at(class_scores(model), F.col("prediction").cast("int") + F.lit(1))
    back = scored.withColumns(
        {"model_score": picked, "prediction": F.col("prediction").cast("int")}
    )
    drop = [c for c in ("features", "scaled", "rawPrediction", "probability") if c in back.columns]
    restored = back.drop(*drop, *names).withColumnsRenamed({f"_o_{n}": n for n in kept})
    return describe_predictions(restored, version, mapping), checked.where(F.col("rejected").isNotNull())


def without_model(rows: DataFrame) -> DataFrame:
    """The honest answer when no model is installed: nothing is made up."""
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        "grid_id",
        F.lit(C.NO_MODEL_CLASS).alias("classification"),
        none("int").alias("predicted_class"),
        none("double").alias("confidence_score"),
        none("double").alias("model_score"),
        none("string").alias("classification_label"),
        F.array(F.lit(C.NO_MODEL_EVIDENCE)).alias("evidence"),
        F.lit(C.NO_MODEL_EVIDENCE).alias("explanation_summary"),
        F.lit(C.NO_MODEL_VERSION).alias("model_version"),
        F.lit(True).alias("is_mock"),
    )
