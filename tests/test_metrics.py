"""Quantiles, running totals, deduplication, metrics, audits, splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import ordered
from emberfield.functions.ordered import exact_quantiles, keep_one, running_totals
from emberfield.operators import metrics, profile, quality, splits


def test_quantiles_with_a_value_that_fills_a_third(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate([np.full(700, 3.25), rng.normal(size=1400)])
    b = rng.integers(0, 5, 2100).astype(float)
    rows = [(float(x), None if i % 10 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    shares = [0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in exact_quantiles(df, {"a": shares, "b": [0.5]}).collect()}
    assert len(got) == len(shares) + 1
    for s in shares:
        assert got["a", s] == pytest.approx(np.quantile(a, s), abs=1e-12)
    assert got["b", 0.5] == np.quantile([y for _, y in rows if y is not None], 0.5)


def test_running_totals(spark):
    rows = [(g, float(x), int(x) % 7) for g in ("p", "q") for x in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r["g"], r["v"]): r["n_upto"] for r in running_totals(df, "v", ["n"], by="g", parts=8).collect()}
    total = np.cumsum([x % 7 for x in range(500)])
    assert all(got[g, float(x)] == total[x] for g in ("p", "q") for x in range(500))


def test_no_window_over_one_partition(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    quantiles = exact_quantiles(df, {"x": [0.5]})
    plan = quantiles._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_keep_first_and_last(spark):
    rows = [("k", i, f"v{i}") for i in range(300)] + [("m", 1, None)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    assert {tuple(r) for r in keep_one(df, ["k"], ["t"]).collect()} == {("k", 0, "v0"), ("m", 1, None)}
    assert {tuple(r) for r in keep_one(df, ["k"], ["t"], last=True).collect()} == {("k", 299, "v299"), ("m", 1, None)}


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    report = {r["label"]: r for r in metrics.class_report(df).collect()}
    assert report[1]["precision"] == report[1]["f1"] == 0.0 and report[1]["support"] == 1
    assert report[3]["support"] == 0
    matrix = {r["label"]: tuple(r)[1:] for r in metrics.confusion_matrix(df).collect()}
    assert matrix == {0: (2, 0, 0, 0), 1: (1, 0, 0, 0), 2: (0, 0, 1, 0), 3: (0, 0, 0, 0)}
    row = metrics.summary_metrics(df).first()
    assert row["macro_f1"] == pytest.approx((0.8 + 0 + 1) / 3)
    assert row["balanced_accuracy"] == pytest.approx((1 + 0 + 1) / 3)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(11)
    score = rng.integers(0, 40, 600) / 40
    label = (rng.random(600) < score).astype(int)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "label int, score double")
    pos, neg = score[label == 1], score[label == 0]
    pairs = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    row = metrics.area_under_curves(df).first()
    assert row["roc_auc"] == pytest.approx(pairs)
    points, tp, fp = [(0.0, 1.0)], 0, 0
    for s in sorted(set(score), reverse=True):
        tp, fp = tp + (pos == s).sum(), fp + (neg == s).sum()
        points.append((tp / len(pos), tp / (tp + fp)))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert row["pr_auc"] == pytest.approx(area)


def test_class_weights_keep_every_row(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 9 + [(7,)], "label int")
    got = {r["label"]: r["weight"] for r in metrics.with_class_weight(df).distinct().collect()}
    assert got == {0: 100 / (3 * 90), 1: 100 / (3 * 9), 7: 100 / 3}
    assert metrics.with_class_weight(df).count() == 100


def test_importance_shares_of_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "feature string, importance double")
    assert [r["importance_percent"] for r in metrics.importance_shares(df).collect()] == [0.0, 0.0]


def test_feature_gate_and_audits(spark):
    names = ["x", "y"]
    df = spark.createDataFrame([(1.0, float("nan"), 0), (float("inf"), None, 5)], "x double, y double, target_multiclass int")
    got = {r["column"]: (r["missing"], r["invalid"]) for r in quality.feature_gate(df, names).collect()}
    assert got == {"x": (0, 1), "y": (2, 0), "target_multiclass": (0, 1)}
    with pytest.raises(ValueError, match="target_multiclass, x, y"):
        quality.require_clean(df, names)
    assert quality.schema_audit()["schema_safe"]
    assert not quality.schema_audit(["grid_id", "target_multiclass"])["schema_safe"]


def test_split_keeps_blocks_together(spark):
    df = spark.createDataFrame(
        [(10 + i / 100, 70 + j / 100, 0) for i in range(60) for j in range(60)], "lat_grid double, lon_grid double, target_multiclass int"
    )
    table = splits.block_split(df)
    assert splits.shared_blocks(table).count() == 0
    summary = splits.split_summary(table).collect()
    assert sum(r["rows"] for r in summary) == 3600 and all(r["leaking_blocks"] == 0 for r in summary)


def test_months_and_shares(spark):
    df = spark.createDataFrame([("2023-11-30",), ("2024-03-01",)], "d string").select(F.col("d").cast("date").alias("acq_date"))
    assert [str(r["month"]) for r in profile.missing_months(df).orderBy("month").collect()] == ["2023-12-01", "2024-01-01", "2024-02-01"]
    rows = [("a", "2024-01-31"), ("a", "2024-01-02"), ("a", "2024-04-01"), ("b", "2024-02-01"), ("b", "2024-03-01"), ("c", "2023-12-31"), ("c", None)]
    own = spark.createDataFrame(rows, "k string, d string").select("k", F.col("d").cast("date").alias("acq_date"))
    got = [(r["k"], str(r["month"])) for r in profile.missing_months(own, by=["k"]).orderBy("k", "month").collect()]
    assert got == [("a", "2024-02-01"), ("a", "2024-03-01")]


def test_quality_report_counts_copies(spark):
    rows = [(91.0, 0.0, "2024-01-01")] * 3 + [(1.0, None, "2024-01-02")]
    df = spark.createDataFrame(rows, "latitude double, longitude double, acq_date string")
    row = profile.quality_report(df).first()
    assert (row["row_count"], row["exact_duplicates"], row["invalid_latitude"], row["missing_cells"]) == (4, 2, 3, 1)


def test_quantiles_sort_only_the_ranges_that_hold_an_asked_rank(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.lognormal(0, 4, 30_000), -rng.random(20_000), np.full(9, 1e300)])
    df = spark.createDataFrame([(float(v), None) for v in x], "x double, empty double")
    shares = [0.05, 0.25, 0.5, 0.9, 0.999]
    table = exact_quantiles(df, {"x": shares, "empty": [0.5]})
    got = {(r["column"], r["share"]): r["value"] for r in table.collect()}
    assert got == {("x", s): pytest.approx(np.quantile(x, s), rel=1e-12) for s in shares}
    # The rows that reach the only sort by value.
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Sort [key" in plan and "v#" in plan.split("Sort [key")[1].splitlines()[0]
    values = df.select(F.lit("x").alias("key"), F.col("x").alias("v")).groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([("x", "x", s, "lo", int(s * (len(x) - 1))) for s in shares], "key string, column string, share double, end string, rank long")
    left, inner = ordered._narrowed(values, asked)
    assert inner.count() == len(shares) and left.count() < 0.01 * values.count()


def test_running_totals_over_many_ranges(spark):
    rng = np.random.default_rng(9)
    v = np.unique(rng.normal(size=20_000))
    df = spark.createDataFrame([(float(x), 1) for x in v], "v double, n int")
    got = {r["v"]: r["n_upto"] for r in running_totals(df, "v", ["n"]).collect()}
    assert all(got[float(x)] == i + 1 for i, x in enumerate(v))
