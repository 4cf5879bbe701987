"""Coercion, confidence scores, ratios and heuristic labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from emberfield.constants import ARCHIVE_UNKNOWN_CONFIDENCE, CONFIDENCE_SCORES

# Fixed pattern: what counts as a number when text is coerced.
_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def finite_or_null(value: Column) -> Column:
    """NaN and NULL are the same thing here: missing."""
    return F.when(~F.isnan(value), value)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def is_finite(value: Column) -> Column:
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.coalesce(~(F.isnan(value) | infinite), F.lit(False))


def _score(letter: Column) -> Column:
    out = F.lit(None).cast("double")
    for key, score in CONFIDENCE_SCORES.items():
        out = F.when(letter == key, F.lit(score)).otherwise(out)
    return out


def archive_confidence(confidence: Column) -> Column:
    """Archive rule for letters: exact match, everything else is medium."""
    return F.coalesce(_score(confidence), F.lit(ARCHIVE_UNKNOWN_CONFIDENCE))


def live_confidence(confidence: Column) -> Column:
    """Live rule: trimmed lower-case letter, else the number itself, else NULL."""
    return F.coalesce(_score(F.lower(F.trim(confidence))), to_number(confidence))


def flag(condition: Column) -> Column:
    """1 where true; 0 where false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def hour_of(hhmm: Column) -> Column:
    return F.floor(hhmm / F.lit(100)).cast("int")


def minute_of(hhmm: Column) -> Column:
    return F.pmod(hhmm, F.lit(100)).cast("int")


def acquisition_time(date: Column, hhmm: Column) -> Column:
    """Date plus zero-padded HHMM as a timestamp; NULL when it is no clock time."""
    text = F.concat_ws(" ", date.cast("string"), F.lpad(hhmm.cast("string"), 4, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HHmm"))


@dataclass(frozen=True)
class LabelRule:
    """Thresholds of the heuristic multiclass label."""

    persistent_active_days: int = 10
    persistent_span_days: int = 60
    persistent_night_ratio: float = 0.20
    industrial_active_days: int = 4
    industrial_night_ratio: float = 0.25
    industrial_mean_frp: float = 4.0
    industrial_active_days_alone: int = 7
    vegetation_active_days: int = 3
    vegetation_span_days: int = 14
    vegetation_night_ratio: float = 0.15


def multiclass_label(rule: LabelRule = LabelRule()) -> Column:
    """2 persistent, 1 industrial, 0 vegetation, 3 other; first match wins."""
    c = F.col
    persistent = (
        (c("active_days") >= rule.persistent_active_days)
        & (c("persistence_days") >= rule.persistent_span_days)
        & (c("night_ratio") >= rule.persistent_night_ratio)
    )
    industrial = (
        (c("active_days") >= rule.industrial_active_days)
        & (c("night_ratio") >= rule.industrial_night_ratio)
        & (
            (c("type_2_count") > 0)
            | (c("mean_frp") >= rule.industrial_mean_frp)
            | (c("active_days") >= rule.industrial_active_days_alone)
        )
    )
    vegetation = (
        (c("active_days") <= rule.vegetation_active_days)
        & (c("persistence_days") <= rule.vegetation_span_days)
        & (c("night_ratio") < rule.vegetation_night_ratio)
        & (c("type_2_count") == 0)
    )
    return F.when(persistent, 2).when(industrial, 1).when(vegetation, 0).otherwise(3)


def binary_label(multiclass: Column) -> Column:
    return F.coalesce(multiclass.isin(1, 2).cast("int"), F.lit(0))


def documented_binary_label(
    min_active_days: int = 5, min_span_days: int = 30, min_night_ratio: float = 0.30
) -> Column:
    """The alternative binary rule of the written plan, kept as a parameter set."""
    by_time = (
        (F.col("active_days") >= min_active_days)
        & (F.col("persistence_days") >= min_span_days)
        & (F.col("night_ratio") >= min_night_ratio)
    )
    return flag((F.col("type_2_count") > 0) | by_time)


def lookup(value: Column, texts: dict[int, str]) -> Column:
    """Text of a small fixed mapping, NULL when the key is unknown."""
    out = F.lit(None).cast("string")
    for key, text in texts.items():
        out = F.when(value == key, F.lit(text)).otherwise(out)
    return out
