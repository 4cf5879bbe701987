"""Feature gates and leakage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberfield.constants import (
    BINARY_TARGET,
    CLASSES,
    DETECTION_FEATURES,
    FEATURE_SETS,
    IDENTIFIERS,
    LABEL_INPUTS_DERIVED,
    LABEL_INPUTS_DIRECT,
    TARGET,
    TARGETS,
)
from emberfield.functions import values as v
from emberfield.operators.normalize import number_column
from emberfield.schemas import require_columns

NON_NEGATIVE = [
    "observation_count", "active_days", "day_observations", "night_observations",
    "mean_frp", "max_frp", "std_frp", "type_2_count", "persistence_days",
]
RATIOS = ["recurrence_ratio", "night_ratio", "type_2_ratio"]


def feature_matrix(cells: DataFrame, feature_set: str = "full") -> DataFrame:
    """Keys, target and the features of a named set, coerced to double."""
    names = FEATURE_SETS[feature_set]
    require_columns(cells, [*names, TARGET])
    return cells.select(
        *[c for c in IDENTIFIERS if c in cells.columns],
        F.col(TARGET),
        *[number_column(cells, n).alias(n) for n in names],
    )


def feature_gate(cells: DataFrame, names: list[str] = DETECTION_FEATURES) -> DataFrame:
    """Per feature: missing and infinite values; for the target: bad classes."""
    require_columns(cells, [*names, TARGET])
    counts = []
    for n in names:
        counts.append(F.count_if(F.coalesce(v.is_missing(F.col(n)), F.lit(True))).alias(f"{n}__missing"))
        counts.append(F.count_if(F.abs(F.col(n)) == F.lit(float("inf"))).alias(f"{n}__infinite"))
    counts.append(F.count_if(F.col(TARGET).isNull()).alias("target__missing"))
    counts.append(F.count_if(F.col(TARGET).isNotNull() & ~F.col(TARGET).isin(CLASSES)).alias("target__other"))
    rows = [
        F.struct(
            F.lit(n).alias("column"), F.col(f"{n}__missing").alias("missing"),
            F.col(f"{n}__infinite").alias("invalid"),
        )
        for n in names
    ]
    rows.append(
        F.struct(
            F.lit(TARGET).alias("column"), F.col("target__missing").alias("missing"),
            F.col("target__other").alias("invalid"),
        )
    )
    return cells.agg(*counts).select(F.inline(F.array(*rows)))


def require_clean(cells: DataFrame, names: list[str]) -> DataFrame:
    """Raise when the gate finds anything; otherwise return the table."""
    bad = feature_gate(cells, names).where("missing > 0 or invalid > 0").collect()
    if bad:
        raise ValueError("unusable values in: " + ", ".join(sorted(r["column"] for r in bad)))
    return cells


def range_checks(cells: DataFrame) -> DataFrame:
    """Physical constraints as one row of booleans, with the overall result."""
    checks = {f"{n}_non_negative": F.col(n) >= 0 for n in NON_NEGATIVE}
    checks |= {f"{n}_between_0_1": F.col(n).between(0, 1) for n in RATIOS}
    checks["day_plus_night_equals_observations"] = (
        F.col("day_observations") + F.col("night_observations") == F.col("observation_count")
    )
    checks["active_days_not_exceeding_observations"] = F.col("active_days") <= F.col("observation_count")
    one = cells.agg(
        *[
            F.coalesce(F.every(F.coalesce(check, F.lit(False))), F.lit(True)).alias(name)
            for name, check in checks.items()
        ]
    )
    overall = F.lit(True)
    for name in checks:
        overall = overall & F.col(name)
    return one.withColumn("all_constraints_pass", overall)


def schema_audit(names: list[str] = DETECTION_FEATURES) -> dict:
    """No target and no identifier may be a feature (names only, no data)."""
    targets = sorted(set(names) & set(TARGETS))
    identifiers = sorted(set(names) & set(IDENTIFIERS))
    return {
        "feature_count": len(names),
        "target_in_features": targets,
        "identifiers_in_features": identifiers,
        "schema_safe": not targets and not identifiers,
    }


def feature_file_audit(files: DataFrame, names: list[str] = DETECTION_FEATURES) -> DataFrame:
    """Each written feature file by the columns it says to have: features found and missing, targets and
    identifiers among them; a safe file has all features and none of the others.

    ``files`` has ``file`` and ``columns`` as :mod:`emberfield.sources.heads` reads them.
    """
    have = F.transform(F.coalesce(F.col("columns"), F.array().cast("array<struct<name:string,type:string>>")), lambda c: c["name"])

    def listed(found: Column) -> Column:
        return F.array_join(F.array_sort(found), ",")

    def of(wanted: list[str]) -> Column:
        return F.array(*[F.lit(c) for c in wanted])

    audited = files.select(
        "file",
        F.size(F.array_intersect(have, of(names))).alias("feature_count"),
        listed(F.array_except(of(names), have)).alias("missing_columns"),
        listed(F.array_intersect(have, of(TARGETS))).alias("target_in_features"),
        listed(F.array_intersect(have, of(IDENTIFIERS))).alias("identifiers_in_features"),
    )
    whole = F.concat("missing_columns", "target_in_features", "identifiers_in_features") == ""
    return audited.withColumn("schema_safe", whole)


def target_correlations(cells: DataFrame) -> DataFrame:
    """Correlation of each direct label input with the target."""
    one = cells.agg(
        *[
            F.corr(F.col(c).cast("double"), F.col(TARGET).cast("double")).alias(c)
            for c in LABEL_INPUTS_DIRECT
        ]
    )
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in LABEL_INPUTS_DIRECT]
    return one.select(F.inline(F.array(*rows)))


def label_consistency(cells: DataFrame) -> DataFrame:
    """Rows whose binary label disagrees with the multiclass one."""
    expected = v.binary_label(F.col(TARGET))
    wrong = F.count_if(F.coalesce(expected != F.col(BINARY_TARGET), F.lit(True)))
    return cells.agg(wrong.alias("mismatches")).withColumn("consistent", F.col("mismatches") == 0)


def full_audit(cells: DataFrame, names: list[str] = DETECTION_FEATURES) -> DataFrame:
    """Schema, dependency, correlation and consistency findings as one table."""
    found = schema_audit(names)
    audits = {
        "feature_count": float(found["feature_count"]),
        "target_in_features": float(len(found["target_in_features"])),
        "identifiers_in_features": float(len(found["identifiers_in_features"])),
        "schema_safe": float(found["schema_safe"]),
        **{f"direct:{c}": 1.0 for c in LABEL_INPUTS_DIRECT if c in cells.columns},
        **{f"derived:{c}": 1.0 for c in LABEL_INPUTS_DERIVED if c in cells.columns},
    }
    rows = F.array(
        *[
            F.struct(
                F.lit("dependency" if ":" in k else "schema").alias("section"),
                F.lit(k.split(":")[-1] if ":" in k else k).alias("item"),
                F.lit(x).alias("value"),
            )
            for k, x in audits.items()
        ]
    )
    consistency = label_consistency(cells)
    metadata = consistency.select(F.inline(rows))
    correlations = target_correlations(cells).select(
        F.lit("correlation").alias("section"), F.col("feature").alias("item"), F.col("correlation").alias("value")
    )
    labels = consistency.select(
        F.lit("labels").alias("section"), F.lit("mismatches").alias("item"),
        F.col("mismatches").cast("double").alias("value"),
    )
    return metadata.unionByName(correlations).unionByName(labels)
