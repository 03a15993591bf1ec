"""Every report by name, as a function of a session and a folder of tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.operators import (
    benchmarks,
    cohorts,
    descriptive,
    features,
    findings,
    guarantee,
    model,
    normalize,
    quality,
)
from wardlight.plans.order_encounters import (
    encounters,
    encounters_with_defects,
    extract_files,
    raw_encounters,
    raw_text_encounters,
    table,
)
from wardlight.plans.pipeline import (
    finding_reports,
    refresh_scorecard,
    run_warehouse,
    store_encounters,
    stored_scorecard,
)
from wardlight.schema import canonicalize, unreadable_mask, unreadable_values
from wardlight.sources.encounters import broken_rows, read_raw_csv, whole_rows
from wardlight.sources.shared import build_lock, shared_files, shared_table, source_state

# The key of the test tables' tokens; not a secret.
TOKEN_SECRET = "fixture"

# Constants of a fit, per application and folder.
_limits: dict[tuple, dict] = {}
_fitted: dict[tuple, model.RiskModel] = {}


def normalize_raw(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize(raw_encounters(spark, folder))


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    """The normalized frame: row-wise expressions on the stored encounters, made as they are read."""
    return normalize_raw(spark, folder)


def clean(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.drop_incomplete(normalized(spark, folder))


def _unreadable_values(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_text_encounters(spark, folder)
    return unreadable_values(canonicalize(raw, unreadable_mask(raw).alias("unreadable")))


def _csv_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The whole rows of the CSV extract, normalized."""
    raw = whole_rows(read_raw_csv(spark, extract_files(spark, folder)))
    return _with_doubles(normalize.normalize(raw), "num_medications")


def _csv_broken_rows(spark: SparkSession, folder: str) -> DataFrame:
    return broken_rows(read_raw_csv(spark, extract_files(spark, folder)))


def _stored_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """The checks of a table that was counted while it was written."""
    path = shared_files(
        spark, "checked_encounters", folder, lambda path: store_encounters(encounters_with_defects(spark, folder), path)
    )
    return stored_scorecard(spark, path, max_null_pct_by_column={"readmitted": 1.0})


def _monthly_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The scorecard written for all months but the last five, then refreshed with these and more of an older one."""
    late = F.col("admission_date") >= F.lit("1998-04-01").cast("timestamp_ntz")
    reopened = F.trunc(F.col("admission_date").cast("date"), "month") == F.lit("1995-06-01").cast("date")
    new = F.coalesce(late | (reopened & (F.col("encounter_id") % 2 == 0)), F.lit(False))

    def write(path: str) -> None:
        table = encounters(spark, folder)
        refresh_scorecard(table.where(~new), f"{path}/states", "first", f"{path}/scorecard")
        for _ in range(2):  # the second time changes nothing
            refresh_scorecard(table.where(new), f"{path}/states", "second", f"{path}/scorecard")

    return spark.read.parquet(f"{shared_files(spark, 'monthly_refresh', folder, write)}/scorecard").drop("month")


def _quarter_guarantee(spark: SparkSession, folder: str) -> DataFrame:
    quarter = "Q2 1996"
    return finding_reports(encounters(spark, folder), quarter)["period_guarantee"]


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table with the 30-day flag the findings average."""
    return encounters(spark, folder).withColumn(
        "readmitted_30d", F.col("readmitted").eqNullSafe("<30").cast("int")
    )


def model_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The narrow rows of the model, stored once: the split, the fit and all scores read them."""
    return shared_table(spark, "model_frame", folder, lambda: features.model_frame(clean(spark, folder)))


def split_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Model rows with their side; the split is decided once per application."""
    key = (spark.conf.get("spark.app.id", "application"), source_state(spark, folder))
    frame = model_frame(spark, folder)
    with build_lock:
        if key not in _limits:
            _limits[key] = features.split_limits(frame)
    return features.with_side(frame, _limits[key])


def fitted(spark: SparkSession, folder: str) -> model.RiskModel:
    """The model of this application and folder; fitted when first asked for."""
    key = (spark.conf.get("spark.app.id", "application"), source_state(spark, folder))
    with build_lock:
        if key not in _fitted:
            _fitted[key] = model.fit_risk_model(split_frame(spark, folder))
    return _fitted[key]


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return model.score(fitted(spark, folder), split_frame(spark, folder))


def scored_test(spark: SparkSession, folder: str) -> DataFrame:
    return model.score(
        fitted(spark, folder), split_frame(spark, folder).where(F.col("is_test") == 1)
    )


def _on(frame: Callable, report: Callable, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: report(frame(spark, folder), **options)


def _with_doubles(frame: DataFrame, *more: str) -> DataFrame:
    """Numbers that can be unknown as doubles."""
    names = ("age_numeric", "time_in_hospital", *more)
    return frame.withColumns({name: F.col(name).cast("double") for name in names})


def _norm_encounters(spark: SparkSession, folder: str) -> DataFrame:
    """The normalized frame; numbers that can be unknown show as doubles."""
    return _with_doubles(normalize_raw(spark, folder))


def _dimensions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dispositions, specialties and admission sources."""
    nation = table(spark, folder, "nation")
    return (
        nation.select(F.col("n_nationkey").alias("disposition_id")),
        table(spark, folder, "region").select(F.col("r_regionkey").alias("specialty_id")),
        nation.select(F.col("n_nationkey").alias("source_id")),
    )


def _disposition_impact(spark: SparkSession, folder: str) -> DataFrame:
    dispositions, _, _ = _dimensions(spark, folder)
    return benchmarks.disposition_impact(encounters(spark, folder), dispositions)


def _specialty_source_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    _, specialties, sources = _dimensions(spark, folder)
    return benchmarks.specialty_source_benchmark(encounters(spark, folder), specialties, sources)


def _warehouse_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run of all reports on the fact table, written as CSV; its headline figures read back."""
    table_of = encounters(spark, folder)
    path = shared_files(
        spark, "warehouse_run", folder, lambda path: run_warehouse(table_of, *_dimensions(spark, folder), path, "csv")
    )
    figures = descriptive.kpi_summary(table_of)
    return spark.read.schema(figures.schema).csv(f"{path}/kpi_summary", header=True)


def _split_strata(spark: SparkSession, folder: str) -> DataFrame:
    return split_frame(spark, folder).select("encounter_id", "readmitted_30d", "is_test")


def _scaler_stats(spark: SparkSession, folder: str) -> DataFrame:
    return features.scaler_stats(split_frame(spark, folder)).select(
        "feature",
        F.round("mean", 6).alias("mean"),
        F.round("scale", 6).alias("scale"),
        "train_rows",
    )


def _correlation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.correlation_pairs(clean(spark, folder)).withColumn("corr", F.round("corr", 6))


def _lr_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return model.coefficients(fitted(spark, folder), spark).withColumns(
        {"coefficient": F.round("coefficient", 6), "abs_coef": F.round("abs_coef", 6)}
    )


def _risk_drivers(spark: SparkSession, folder: str) -> DataFrame:
    return model.risk_drivers(model.coefficients(fitted(spark, folder), spark)).withColumn(
        "coefficient", F.round("coefficient", 6)
    )


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        # Data quality
        "input_profile": _on(raw_encounters, normalize.input_profile),
        "dq_null_counts": _on(encounters_with_defects, quality.null_counts),
        "dq_age_out_of_range": _on(encounters_with_defects, quality.implausible_ages),
        "dq_duplicate_encounters": _on(encounters_with_defects, quality.duplicate_encounters),
        "dq_unreadable_values": _unreadable_values,
        "csv_extract": _csv_extract,
        "dq_broken_rows": _csv_broken_rows,
        "dq_null_profile": _on(normalized, quality.null_profile),
        "dq_scorecard": _on(
            encounters_with_defects, quality.scorecard, max_null_pct_by_column={"readmitted": 1.0}
        ),
        "dq_scorecard_stored": _stored_scorecard,
        # Normalization
        "norm_encounters": _norm_encounters,
        "norm_drop_critical": _on(normalized, normalize.drop_summary),
        # Descriptive
        "kpi_summary": _on(encounters, descriptive.kpi_summary),
        "warehouse_run": _warehouse_run,
        "kpi_long": _on(clean, descriptive.kpi_list),
        "quarterly_trend": _on(encounters, descriptive.quarterly_trend),
        "readmission_distribution": _on(clean, descriptive.readmission_distribution),
        "los_box_stats": _on(clean, descriptive.los_box_stats),
        "age_rate_panel": _on(clean, descriptive.age_rate_panel),
        "medication_curve": _on(clean, descriptive.medication_curve),
        # Cohorts
        "diagnosis_risk_top20": _on(encounters, cohorts.diagnosis_risk),
        "diagnosis_risk_top10": _on(clean, cohorts.diagnosis_stats, top=10),
        "service_opportunities": _on(encounters, cohorts.service_opportunities),
        "age_cohort_rank": _on(encounters, cohorts.age_cohort_rank),
        "correlation_pairs": _correlation_pairs,
        "medication_tiers": _on(encounters, cohorts.medication_tiers),
        # Joins and benchmarks
        "disposition_impact": _disposition_impact,
        "specialty_source_benchmark": _specialty_source_benchmark,
        # Features and model
        "model_features": _on(encounters, features.model_features),
        "model_frame": model_frame,
        "split_strata": _split_strata,
        "scaler_stats": _scaler_stats,
        "lr_coefficients": _lr_coefficients,
        "risk_scores": _on(scored, model.risk_scores, secret=TOKEN_SECRET),
        "patient_risk": _on(scored, model.patient_risk, secret=TOKEN_SECRET),
        "model_metrics": _on(scored_test, model.model_metrics),
        "classification_report": _on(scored_test, model.classification_report),
        "risk_drivers": _risk_drivers,
        # Contract reports and findings
        "monthly_scorecard": _on(encounters, guarantee.monthly_scorecard),
        "monthly_refresh": _monthly_refresh,
        "period_guarantee": _on(clean, guarantee.period_guarantee, period="all admissions"),
        "quarter_guarantee": _quarter_guarantee,
        "polypharmacy_ratio": _on(clean, findings.polypharmacy_ratio),
        "top5_diagnosis_share": _on(clean, findings.top_diagnosis_share),
        "disposition_ratio": _on(
            flagged, findings.disposition_ratio, disposition="O", compared_with="F"
        ),
        "leading_age_bands": _on(clean, findings.leading_age_bands),
    }
