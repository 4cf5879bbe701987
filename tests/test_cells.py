"""Cell aggregation against pandas, with one cell holding a third of the rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from emberfield.operators import cells, normalize


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 3000
    hot = np.arange(n) < n // 3
    return pd.DataFrame(
        {
            "latitude": np.where(hot, 20.004, 8 + rng.integers(0, 300, n) / 100),
            "longitude": np.where(hot, 80.001, 70 + rng.integers(0, 5, n) / 100),
            "acq_date": [dt.date(2024, 1, 1) + dt.timedelta(days=int(x)) for x in rng.integers(0, 200, n)],
            "daynight": rng.choice(["D", "N"], n),
            "type": rng.choice([0, 2], n),
            "confidence": rng.choice(["l", "n", "h", "q"], n),
            "frp": rng.integers(0, 40, n) / 4,
            "brightness": 300 + rng.integers(0, 40, n) / 4,
            "bright_t31": 280 + rng.integers(0, 40, n) / 4,
        }
    )


def _expected(pdf: pd.DataFrame, ddof: int) -> pd.DataFrame:
    w = pdf.copy()
    w["lat_grid"] = (w.latitude / 0.01).round() * 0.01
    w["lon_grid"] = (w.longitude / 0.01).round() * 0.01
    w["grid_id"] = w.lat_grid.round(4).astype(str) + "_" + w.lon_grid.round(4).astype(str)
    w["acq_date"] = pd.to_datetime(w.acq_date)
    return w.groupby("grid_id").agg(
        observation_count=("latitude", "size"),
        active_days=("acq_date", "nunique"),
        mean_frp=("frp", "mean"),
        max_frp=("frp", "max"),
        std_frp=("frp", lambda s: s.std(ddof=ddof)),
        first=("acq_date", "min"),
        last=("acq_date", "max"),
        night=("daynight", lambda s: int((s == "N").sum())),
    )


def test_archive_cells_match_pandas_with_a_hot_cell(spark, skewed):
    got = cells.build_cells(normalize.prepare_archive(spark.createDataFrame(skewed))).toPandas().set_index("grid_id")
    want = _expected(skewed, 1).fillna({"std_frp": 0.0})
    assert got.observation_count.max() >= len(skewed) // 3
    got, want = got.sort_index(), want.sort_index()
    assert list(got.index) == list(want.index)
    for c in ("observation_count", "active_days", "mean_frp", "max_frp"):
        assert (got[c] == want[c]).all()
    assert np.allclose(got.std_frp, want.std_frp)
    assert (got.night_observations == want.night).all()
    assert (got.persistence_days == (want["last"] - want["first"]).dt.days + 1).all()


def test_one_detection_has_zero_deviation_and_a_span_of_one(spark):
    row = [(20.0, 80.0, dt.date(2024, 1, 1), "N", 0, "h", 2.0, 300.0, 280.0)]
    names = "latitude double, longitude double, acq_date date, daynight string, type int, confidence string, frp double, brightness double, bright_t31 double"
    base = normalize.prepare_archive(spark.createDataFrame(row, names))
    old, live = cells.build_cells(base).first(), cells.aggregate_live(base).first()
    assert old["std_frp"] == 0.0 and live["std_frp"] == 0.0
    assert old["persistence_days"] == live["persistence_days"] == 1
    assert live["type_2_count"] is None and live["target_multiclass"] is None


def test_live_deviation_is_population(spark, skewed):
    got = cells.aggregate_live(normalize.prepare_archive(spark.createDataFrame(skewed))).toPandas()
    want = _expected(skewed, 0)
    merged = got.set_index("grid_id").join(want, rsuffix="_w")
    assert np.allclose(merged.std_frp, merged.std_frp_w)


def test_candidates(spark):
    rows = spark.createDataFrame([(3, 2), (3, 1), (2, 2)], "observation_count int, active_days int")
    assert cells.context_candidates(rows).count() == 1
