"""Aggregations, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.catalog import registry as r
from emberfield.catalog.joins import RESULTS_SQL, _rule_results
from emberfield.catalog.registry import query, rounded
from emberfield.functions.ordered import exact_quantiles
from emberfield.operators import cells, context, events, metrics, normalize, profile, quality
from emberfield.sources import views

_CELL = (
    "grid_id, lat_grid, lon_grid, observation_count, first_seen, last_seen, active_days, day_observations,"
    " night_observations, mean_frp, max_frp, round({std}, 6) AS std_frp, mean_brightness, max_brightness,"
    " mean_bright_t31, max_bright_t31, mean_confidence_score"
)


@query("a1_cell_aggregate", f"SELECT {_CELL.format(std='std_frp')}, type_2_count FROM {{agg}}")
def a1(spark, folder):
    return rounded(cells.aggregate_archive(r.archive(spark, folder)), "std_frp")


@query(
    "a2_live_cell_aggregate",
    f"SELECT {_CELL.format(std='std_frp')}, persistence_days, recurrence_ratio, obs_per_active_day, night_ratio,"
    " CAST(NULL AS BIGINT) AS type_2_count, CAST(NULL AS DOUBLE) AS type_2_ratio,"
    " CAST(NULL AS INT) AS target_persistent_source, CAST(NULL AS INT) AS target_multiclass FROM {live_cells}",
)
def a2(spark, folder):
    return rounded(r.live_cells(spark, folder), "std_frp")


@query(
    "a3_event_statistics",
    """SELECT count(*) AS total_spatial_cells, CAST(coalesce(sum(observation_count),0) AS BIGINT) AS total_raw_observations,
        count(*) FILTER (WHERE target_persistent_source=1) AS persistent_candidate_cells,
        count(*) FILTER (WHERE target_persistent_source=0) AS ephemeral_candidate_cells,
        count(*) FILTER (WHERE target_persistent_source IS NULL) AS unclassified_candidate_cells,
        count(*) FILTER (WHERE target_persistent_source IS NOT NULL) AS labelled_candidate_cells,
        max(active_days) AS max_active_days, max(persistence_days) AS max_persistence_days,
        round(avg(night_ratio), 6) AS mean_night_ratio,
        count(*) FILTER (WHERE osm_context_available) AS osm_context_cells
      FROM (SELECT * FROM {events_t} UNION ALL BY NAME SELECT * FROM {live_events})""",
)
def a3(spark, folder):
    live = events.live_event_records(r.live_cells(spark, folder))
    rows = r.event_table(spark, folder).unionByName(live)
    return rounded(events.event_statistics(rows), "mean_night_ratio")


@query(
    "a4_provenance_audit",
    """SELECT count(*) FILTER (WHERE event_id LIKE 'firms-%') AS live_total,
        count(*) FILTER (WHERE event_id LIKE 'firms-%' AND osm_context_available) AS verified_osm,
        count(*) FILTER (WHERE event_id LIKE 'firms-%' AND NOT osm_context_available) AS osm_unavailable,
        count(*) FILTER (WHERE event_id LIKE 'firms-%' AND NOT osm_context_available
          AND (osm_feature_count IS NOT NULL OR osm_industrial_count IS NOT NULL OR osm_power_count IS NOT NULL
               OR osm_manmade_count IS NOT NULL OR osm_min_distance_m IS NOT NULL)) AS invalid_unknown_values
      FROM {events_t}""",
)
def a4(spark, folder):
    return context.provenance_audit(r.event_table(spark, folder))


_VC = ["satellite", "instrument", "confidence", "daynight", "type"]


@query(
    "a5_value_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n,"
        f" count(*) / (SELECT count(*) FROM {{det}})::double AS share FROM {{det}} GROUP BY {c}"
        for c in _VC
    ),
)
def a5(spark, folder):
    return profile.value_counts(views.detections(spark, folder), _VC)


def _clean(spark, folder):
    return normalize.clean_detections(views.detections(spark, folder))


def _top_rows(spark, folder):
    chosen = profile.top_cells(profile.exploration_cell_counts(views.detections(spark, folder)), 50)
    return profile.rows_in_cells(_clean(spark, folder), chosen)


@query("a6_top_cell_persistence", "SELECT * FROM {persistence}")
def a6(spark, folder):
    return profile.cell_persistence(_top_rows(spark, folder))


@query("a7_top_cell_profile", "SELECT * FROM {profile}")
def a7(spark, folder):
    return profile.cell_profile(_top_rows(spark, folder))


@query(
    "a8_profile_summary",
    """SELECT count(*) AS cells, round(avg(active_days),6) AS mean_active_days, round(avg(mean_frp),6) AS mean_frp,
        round(avg(type_2_pct),6) AS mean_type_2_pct, round(avg(high_confidence),6) AS mean_high_confidence,
        CAST(median(active_days) AS DOUBLE) AS median_active_days FROM {profile}""",
)
def a8(spark, folder):
    rows = profile.profile_summary(profile.cell_profile(_top_rows(spark, folder)))
    return rounded(rows, "mean_active_days", "mean_frp", "mean_type_2_pct", "mean_high_confidence")


_NUM = ["latitude", "longitude", "brightness", "bright_t31", "frp"]


@query(
    "a9_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS std,"
        f" min({c}) AS min, round(quantile_cont({c},0.25),6) AS p25, round(quantile_cont({c},0.5),6) AS p50,"
        f" round(quantile_cont({c},0.75),6) AS p75, max({c}) AS max FROM {{det}}"
        for c in _NUM
    ),
)
def a9(spark, folder):
    rows = profile.describe(views.detections(spark, folder), _NUM)
    return rounded(rows, "mean", "std", "p25", "p50", "p75")


_QUANTILES = {
    "frp": profile.PERCENTILES_FRP,
    "brightness": profile.PERCENTILES_BRIGHTNESS,
    "bright_t31": profile.PERCENTILES_BRIGHTNESS,
}


@query(
    "a10_exact_percentiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {float(p)!r}::double AS share, round(quantile_cont({c}, {float(p)!r}), 6) AS value FROM {{det}}"
        for c, ps in _QUANTILES.items()
        for p in ps
    ),
)
def a10(spark, folder):
    return rounded(exact_quantiles(views.detections(spark, folder), _QUANTILES), "value")


@query(
    "a11_quality_report",
    """SELECT (SELECT count(*) FROM {live_rep}) AS row_count, CAST(11 AS BIGINT) AS column_count,
        (SELECT count(*) FROM {live_rep}) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (eid) FROM {live_rep})) AS exact_duplicates,
        CAST(0 AS BIGINT) AS missing_cells,
        (SELECT count(*) FROM {live_rep} WHERE latitude < -90 OR latitude > 90) AS invalid_latitude,
        (SELECT count(*) FROM {live_rep} WHERE longitude < -180 OR longitude > 180) AS invalid_longitude,
        (SELECT min(acq_date) FROM {live_rep}) AS min_date, (SELECT max(acq_date) FROM {live_rep}) AS max_date,
        (SELECT count(DISTINCT acq_date) FROM {live_rep}) AS unique_dates""",
)
def a11(spark, folder):
    return profile.quality_report(views.live_detections(spark, folder, repeats=True))


@query(
    "a11_dataset_report",
    """SELECT count(*) AS row_count, CAST(33 AS BIGINT) AS column_count,
        count(*) - count(DISTINCT grid_id) AS duplicate_rows, count(*) - count(DISTINCT grid_id) AS duplicate_grid_ids,
        CAST(5 * count(*) FILTER (WHERE NOT osm_context_available) AS BIGINT) AS missing_values,
        CAST(0 AS BIGINT) AS infinite_values FROM {events_t}""",
)
def a11_cells(spark, folder):
    return profile.dataset_report(r.event_table(spark, folder))


@query(
    "a11_missing_summary",
    "SELECT 'type_2_count' AS \"column\", count(*) - count(type_2_count) AS missing_count,"
    " round((count(*) - count(type_2_count))*100.0::double/count(*), 2) AS missing_percent FROM {u}"
    " UNION ALL SELECT 'grid_id', count(*) - count(grid_id), 0.0::double FROM {u}"
    " UNION ALL SELECT 'osm_min_distance_m', count(*) - count(osm_min_distance_m),"
    " round((count(*) - count(osm_min_distance_m))*100.0::double/count(*), 2) FROM {u}".replace(
        "{u}", "(SELECT * FROM {events_t} UNION ALL BY NAME SELECT * FROM {live_events})"
    ),
)
def a11_missing(spark, folder):
    live = events.live_event_records(r.live_cells(spark, folder))
    rows = r.event_table(spark, folder).unionByName(live)
    return profile.missing_summary(rows.select("type_2_count", "grid_id", "osm_min_distance_m"))


@query(
    "a12_counts_per_day_month_hour",
    "SELECT 'day' AS period, CAST(acq_date AS VARCHAR) AS key, count(*) AS n FROM {clean} GROUP BY acq_date"
    " UNION ALL SELECT 'month', strftime(acq_date, '%Y-%m'), count(*) FROM {clean} GROUP BY 2"
    " UNION ALL SELECT 'hour', CAST(acq_time//100 AS VARCHAR), count(*) FROM {clean} GROUP BY 2",
)
def a12(spark, folder):
    rows = normalize.with_clock(views.detections(spark, folder))
    periods = F.array(
        *[
            F.struct(F.lit(name).alias("period"), key.alias("key"))
            for name, key in (
                ("day", F.col("acq_date").cast("string")),
                ("month", F.date_format("acq_date", "yyyy-MM")),
                ("hour", F.col("acq_hour").cast("string")),
            )
        ]
    )
    # One scan: each row counts towards its day, month and hour, folded map-side.
    return rows.select(F.inline(periods)).groupBy("period", "key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a13_threshold_counts",
    " UNION ALL ".join(
        f"SELECT CAST({t} AS INT) AS threshold, count(*) FILTER (WHERE observation_count >= {t}) AS cells FROM {{counts}}"
        for t in profile.OBSERVATION_THRESHOLDS
    ),
)
def a13(spark, folder):
    return profile.threshold_counts(profile.exploration_cell_counts(views.detections(spark, folder)))


@query(
    "a14_target_correlations",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(target_multiclass AS DOUBLE)), 6) AS correlation FROM {{cells}}"
        for c in ("active_days", "persistence_days", "night_ratio", "type_2_count", "mean_frp")
    ),
)
def a14(spark, folder):
    return rounded(quality.target_correlations(r.labelled_cells(spark, folder)), "correlation")


@query(
    "a15_distinct_counts",
    "SELECT count(*) AS row_count, count(DISTINCT acq_date) AS dates, count(DISTINCT grid_id) AS cells,"
    " count(DISTINCT (latitude, longitude)) AS coordinate_pairs, count(DISTINCT satellite) AS satellites,"
    " count(DISTINCT instrument) AS instruments FROM {clean}",
)
def a15(spark, folder):
    return profile.distinct_counts(_clean(spark, folder))


@query(
    "a16_confusion_matrix",
    "SELECT CAST(k AS INT) AS label, "
    + ", ".join(f"(SELECT count(*) FROM {{pred}} WHERE label=k AND prediction={j}) AS pred_{j}" for j in range(4))
    + " FROM (VALUES (0),(1),(2),(3)) v(k)",
)
def a16(spark, folder):
    return metrics.confusion_matrix(r.rule_predictions(spark, folder))


@query(
    "a17_class_report",
    "SELECT CAST(label AS INT) AS label, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, support FROM {per_class}",
)
def a17(spark, folder):
    return rounded(metrics.class_report(r.rule_predictions(spark, folder)), "precision", "recall", "f1")


@query(
    "a18_macro_scores",
    "SELECT round(avg(f1) FILTER (WHERE support+guessed > 0), 6) AS macro_f1,"
    " round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM {per_class}",
)
def a18(spark, folder):
    return rounded(metrics.summary_metrics(r.rule_predictions(spark, folder)), "macro_f1", "balanced_accuracy")


def _binary(spark, folder):
    return r.rule_predictions(spark, folder).select(
        F.col("target_persistent_source").alias("label"),
        (F.col("active_days") >= 5).cast("int").alias("prediction"),
        "score",
    )


@query(
    "a19_binary_metrics",
    """SELECT tn, fp, fn, tp, round((tp+tn)/(tp+tn+fp+fn)::double,6) AS accuracy,
        round(CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp)::double END,6) AS precision,
        round(CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn)::double END,6) AS recall,
        round(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn)::double END,6) AS f1_score,
        round(CASE WHEN tn+fp=0 THEN 0 ELSE tn/(tn+fp)::double END,6) AS specificity
      FROM (SELECT count(*) FILTER (WHERE y=0 AND p=0) AS tn, count(*) FILTER (WHERE y=0 AND p=1) AS fp,
                   count(*) FILTER (WHERE y=1 AND p=0) AS fn, count(*) FILTER (WHERE y=1 AND p=1) AS tp
            FROM (SELECT target_persistent_source AS y, CAST(active_days>=5 AS INT) AS p FROM {cells}))""",
)
def a19(spark, folder):
    rows = metrics.binary_metrics(_binary(spark, folder))
    return rounded(rows, "accuracy", "precision", "recall", "f1_score", "specificity")


@query(
    "a20_area_under_curves",
    """WITH s AS (SELECT score, count(*) FILTER (WHERE target_persistent_source=1) AS p,
                         count(*) FILTER (WHERE target_persistent_source=0) AS n FROM {pred} GROUP BY score),
       c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM s),
       g AS (SELECT *, lag(tp,1,0) OVER (ORDER BY score DESC) AS tp0, lag(fp,1,0) OVER (ORDER BY score DESC) AS fp0,
                    tp/(tp+fp)::double AS pr, lag(tp/(tp+fp)::double,1,1.0::double) OVER (ORDER BY score DESC) AS pr0 FROM c)
       SELECT round(sum((fp-fp0)*(tp+tp0)/2.0::double)/(sum(p)*sum(n))::double, 6) AS roc_auc,
              round(sum((tp-tp0)*(pr+pr0)/2.0::double)/sum(p)::double, 6) AS pr_auc FROM g""",
)
def a20(spark, folder):
    return rounded(metrics.area_under_curves(_binary(spark, folder)), "roc_auc", "pr_auc")


@query(
    "a21_class_weights",
    "SELECT CAST(label AS INT) AS label, count(*) AS n, round((SELECT count(*) FROM {pred})/((SELECT count(DISTINCT label) FROM {pred})*count(*))::double, 6) AS weight"
    " FROM {pred} GROUP BY label",
)
def a21(spark, folder):
    return rounded(metrics.class_weights(r.rule_predictions(spark, folder)), "weight")


@query(
    "a22_geographic_extent",
    "SELECT min(lat_grid) AS south, max(lat_grid) AS north, min(lon_grid) AS west, max(lon_grid) AS east FROM {agg}",
)
def a22(spark, folder):
    return profile.extent(r.grid_cells(spark, folder))


@query(
    "a23_range_checks",
    "SELECT "
    + ", ".join(f"bool_and({c}>=0) AS {c}_non_negative" for c in quality.NON_NEGATIVE)
    + ", "
    + ", ".join(f"bool_and({c} BETWEEN 0 AND 1) AS {c}_between_0_1" for c in quality.RATIOS)
    + ", bool_and(day_observations+night_observations=observation_count) AS day_plus_night_equals_observations,"
    " bool_and(active_days<=observation_count) AS active_days_not_exceeding_observations,"
    " bool_and(recurrence_ratio BETWEEN 0 AND 1 AND night_ratio BETWEEN 0 AND 1 AND type_2_ratio BETWEEN 0 AND 1"
    " AND day_observations+night_observations=observation_count AND active_days<=observation_count) AS all_constraints_pass"
    " FROM {cells}",
)
def a23(spark, folder):
    return quality.range_checks(r.labelled_cells(spark, folder))


@query(
    "a24_pivot_with_deltas",
    "WITH res AS (" + RESULTS_SQL + ") SELECT a.model, "
    + ", ".join(
        f"round(a.{m},6) AS {m}_full, round(b.{m},6) AS {m}_reduced, round(b.{m}-a.{m},6) AS {m}_delta"
        for m in ("macro_f1", "balanced_accuracy", "training_seconds")
    )
    + " FROM res a JOIN res b USING (model) WHERE a.experiment='full' AND b.experiment='reduced'",
)
def a24(spark, folder):
    rows = metrics.pivot_with_delta(_rule_results(spark, folder), "full", "reduced")
    return rounded(rows, *[c for c in rows.columns if c != "model"])


@query(
    "a25_common_window",
    """SELECT max(lo) AS start, min(hi) AS "end", count(*) AS sources, count(*) = 2 AND max(lo) <= min(hi) AS usable
       FROM (SELECT source_dataset, min(acq_date) AS lo, max(acq_date) AS hi FROM {live_raw} GROUP BY 1)""",
)
def a25(spark, folder):
    rows = views.live_detections(spark, folder).groupBy(F.col("source_dataset").alias("data_id")).agg(
        F.min("acq_date").alias("min_date"), F.max("acq_date").alias("max_date")
    )
    return profile.common_window(rows, ["VIIRS_A", "VIIRS_B"])


_CORR = ("active_days", "persistence_days", "night_ratio", "type_2_count", "mean_frp")
_IMPORTANCE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST(target_multiclass AS DOUBLE))) AS importance FROM {{cells}}"
    for c in _CORR
)


@query(
    "a26_importance_shares",
    f"SELECT feature, round(importance,6) AS importance, round(importance*100/sum(importance) OVER (), 6) AS importance_percent"
    f" FROM ({_IMPORTANCE_SQL})",
)
def a26(spark, folder):
    strength = quality.target_correlations(r.labelled_cells(spark, folder)).select(
        "feature", F.abs("correlation").alias("importance")
    )
    return rounded(metrics.importance_shares(strength), "importance", "importance_percent")


@query(
    "a27_persistent_candidates",
    "SELECT grid_id, active_days, activity_ratio FROM {persistence} WHERE active_days >= 100 AND activity_ratio >= 0.1::double",
)
def a27(spark, folder):
    rows = profile.persistent_candidates(profile.cell_persistence(_top_rows(spark, folder)))
    return rows.select("grid_id", "active_days", "activity_ratio")


@query(
    "a28_type_share_in_top_cells",
    "SELECT type, count(*) AS n, round(count(*)/(SELECT count(*) FROM {top_rows})::double*100, 2) AS percent FROM {top_rows} GROUP BY type",
)
def a28(spark, folder):
    return profile.type_shares(_top_rows(spark, folder))


@query(
    "a29_zero_share",
    "SELECT count(*) FILTER (WHERE frp=0) AS zero_rows, count(*) FILTER (WHERE frp>0) AS positive_rows,"
    " round(avg(CASE WHEN frp=0 THEN 100.0::double ELSE 0.0::double END), 3) AS zero_percent FROM {live_raw}",
)
def a29(spark, folder):
    return profile.zero_share(views.live_detections(spark, folder))


@query(
    "a30_context_coverage",
    """SELECT count(*) AS cells, count(*) FILTER (WHERE osm_context_available) AS queried_cells,
        count(*) FILTER (WHERE NOT osm_context_available) AS unqueried_cells,
        count(*) FILTER (WHERE osm_industrial_count > 0) AS industrial_cells,
        count(*) FILTER (WHERE osm_power_count > 0) AS power_cells,
        count(*) FILTER (WHERE osm_manmade_count > 0) AS manmade_cells,
        round(count(*) FILTER (WHERE osm_context_available)*100.0::double/count(*), 2) AS overlap_percent FROM {assembled}""",
)
def a30(spark, folder):
    return context.coverage_summary(r.assembled(r.stored_cells(spark, folder), folder))


@query(
    "t3_extreme_days_and_months",
    """(SELECT 'day' AS period, strftime(acq_date, '%Y-%m-%d') AS key, count(*) AS n, 'largest' AS side FROM {det} GROUP BY 2 ORDER BY n DESC, key LIMIT 10)
       UNION ALL (SELECT 'day', strftime(acq_date, '%Y-%m-%d') AS key, count(*) AS n, 'smallest' FROM {det} GROUP BY 2 ORDER BY n, key LIMIT 10)
       UNION ALL (SELECT 'month', strftime(acq_date, '%Y-%m') AS key, count(*) AS n, 'largest' FROM {det} GROUP BY 2 ORDER BY n DESC, key LIMIT 10)
       UNION ALL (SELECT 'month', strftime(acq_date, '%Y-%m') AS key, count(*) AS n, 'smallest' FROM {det} GROUP BY 2 ORDER BY n, key LIMIT 10)""",
)
def t3(spark, folder):
    rows = views.detections(spark, folder)
    out = None
    for period, pattern in (("day", "yyyy-MM-dd"), ("month", "yyyy-MM")):
        counts = profile.count_by(rows, F.date_format("acq_date", pattern))
        one = profile.extreme_groups(counts, "key").select(F.lit(period).alias("period"), "key", "n", "side")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "t5_ranked_importances",
    f"SELECT feature, round(importance,6) AS importance FROM ({_IMPORTANCE_SQL}) ORDER BY importance DESC, feature LIMIT 3",
)
def t5(spark, folder):
    strength = quality.target_correlations(r.labelled_cells(spark, folder)).select(
        "feature", F.abs("correlation").alias("importance")
    )
    return rounded(metrics.ranked(strength, "importance", "feature", 3), "importance")
