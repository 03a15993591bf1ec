"""The report runs: raw extract to reports and model, fact table to reports."""

import datetime
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardlight.fixed_values import NOT_READMITTED, READMITTED_WITHIN_30
from wardlight.functions.flags import flag_equal, flag_not_equal
from wardlight.operators import (
    benchmarks,
    cohorts,
    descriptive,
    features,
    findings,
    guarantee,
    model,
    normalize,
    one_row,
    quality,
)
from wardlight.operators.one_row import OneRow
from wardlight.schema import unreadable_mask, unreadable_values
from wardlight.sources.encounters import (
    BROKEN_ROW,
    broken_row_counts,
    broken_rows,
    read_raw_csv,
    whole_rows,
    write_encounters,
)
from wardlight.sources.manifest import RunManifest
from wardlight.sources.shared import source_state
from wardlight.sources.sinks import observed_row, write_report


#: The name of the period of a run that is not restricted to one.
ALL_ADMISSIONS = "all admissions"


class QualityCheckFailed(Exception):
    """A data-quality check did not pass; the reports were not written."""


def frame_reports(clean: DataFrame, period: str) -> dict[str, DataFrame]:
    """Every report on the normalized frame, by name."""
    return {
        "kpi_long": descriptive.kpi_list(clean),
        "readmission_distribution": descriptive.readmission_distribution(clean),
        "los_box_stats": descriptive.los_box_stats(clean),
        "age_rate_panel": descriptive.age_rate_panel(clean),
        "medication_curve": descriptive.medication_curve(clean),
        "diagnosis_stats": cohorts.diagnosis_stats(clean),
        "correlation_pairs": cohorts.correlation_pairs(clean),
        "period_guarantee": guarantee.period_guarantee(clean, period),
        "polypharmacy_ratio": findings.polypharmacy_ratio(clean),
        "top5_diagnosis_share": findings.top_diagnosis_share(clean),
        "leading_age_bands": findings.leading_age_bands(clean),
    }


def with_outcomes(encounters: DataFrame) -> DataFrame:
    """The fact table with the outcome flags of the normalized frame."""
    return encounters.withColumns(
        {
            "readmitted_30d": flag_equal("readmitted", READMITTED_WITHIN_30),
            "readmitted_any": flag_not_equal("readmitted", NOT_READMITTED),
        }
    )


def of_period(frame: DataFrame, period: str) -> DataFrame:
    """The rows of a quarter such as "Q4 2024", or all of them for ALL_ADMISSIONS.

    A frame without admission dates cannot be restricted, so a quarter is refused.
    """
    if period == ALL_ADMISSIONS:
        return frame
    if "admission_date" not in frame.columns:
        raise ValueError(f"cannot report on {period!r}: the extract has no admission_date")
    return in_quarter(frame, period)


def finding_reports(
    encounters: DataFrame, period: str, compared_dispositions: tuple[str, str] | None = None
) -> dict[str, DataFrame]:
    """Contract summary and findings of a period on the fact table, by name."""
    flagged = of_period(with_outcomes(encounters), period)
    found = {
        "period_guarantee": guarantee.period_guarantee(flagged, period),
        "polypharmacy_ratio": findings.polypharmacy_ratio(flagged),
        "top5_diagnosis_share": findings.top_diagnosis_share(flagged),
        "leading_age_bands": findings.leading_age_bands(flagged),
    }
    if compared_dispositions:
        first, second = compared_dispositions
        found["disposition_ratio"] = findings.disposition_ratio(flagged, disposition=first, compared_with=second)
    return found


def one_row_parts(
    period: str, within: Column | None, compared_dispositions: tuple[str, str] | None = None
) -> dict[str, OneRow]:
    """The reports of one row on the fact table with its outcomes, by name."""
    parts = {
        "dq_null_counts": quality.null_counts_part(),
        "kpi_summary": descriptive.kpi_summary_part(),
        "period_guarantee": guarantee.period_guarantee_part(period, within=within),
        "polypharmacy_ratio": findings.polypharmacy_part(within=within),
    }
    if compared_dispositions:
        parts["disposition_ratio"] = findings.disposition_part(*compared_dispositions, within=within)
    return parts


def warehouse_reports(
    encounters: DataFrame,
    dispositions: DataFrame,
    specialties: DataFrame,
    sources: DataFrame,
    period: str = ALL_ADMISSIONS,
    compared_dispositions: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Every report on the fact table and its dimensions, by name.

    `period` restricts the contract summary and the findings; trends show every month. The
    reports of one row are computed here, in one scan; the others are lazy.
    """
    of_period(encounters, period)
    within = None if period == ALL_ADMISSIONS else admitted_in(period)
    parts = one_row_parts(period, within, compared_dispositions)
    flagged = of_period(with_outcomes(encounters), period)
    return {
        **one_row.together(with_outcomes(encounters), parts),
        "top5_diagnosis_share": findings.top_diagnosis_share(flagged),
        "leading_age_bands": findings.leading_age_bands(flagged),
        "dq_age_out_of_range": quality.implausible_ages(encounters),
        "dq_duplicate_encounters": quality.duplicate_encounters(encounters),
        "quarterly_trend": descriptive.quarterly_trend(encounters),
        "diagnosis_risk": cohorts.diagnosis_risk(encounters),
        "service_opportunities": cohorts.service_opportunities(encounters),
        "age_cohort_rank": cohorts.age_cohort_rank(encounters),
        "medication_tiers": cohorts.medication_tiers(encounters),
        "disposition_impact": benchmarks.disposition_impact(encounters, dispositions),
        "specialty_source_benchmark": benchmarks.specialty_source_benchmark(
            encounters, specialties, sources
        ),
        "model_features": features.model_features(encounters),
        "monthly_scorecard": guarantee.monthly_scorecard(encounters),
    }


def run_extract(
    spark: SparkSession,
    csv_path: str,
    out_path: str,
    period: str,
    token_secret: str,
    file_format: str = "parquet",
) -> model.RiskModel:
    """Raw CSV extract to normalized frame, reports, risk model and risk scores.

    The CSV is parsed once: the normalized frame is stored and all later steps read
    only the columns they need from it. Rows whose fields do not fit their header are left
    out and counted in `dq_broken_rows`. `period` is a quarter such as "Q4 2024", which
    needs an admission_date in the extract, or ALL_ADMISSIONS; it restricts the reports,
    not the training of the model. Returns the fitted model.

    A run that was stopped goes on after its last stored step when it is started again with the
    same extract and arguments; nothing stored is made a second time, the fit included.
    """
    inputs = (source_state(spark, csv_path), period, file_format, hashlib.sha256(token_secret.encode()).hexdigest())
    manifest = RunManifest(spark, out_path, *inputs)

    def store(name: str, make: Callable[[], DataFrame], file_format: str = file_format) -> None:
        if not manifest.done(name):
            write_report(make(), f"{out_path}/{name}", file_format)
            manifest.finish(name)

    if not (manifest.done("normalized") and manifest.done("dq_broken_rows") and manifest.done("input_profile")):
        raw = read_raw_csv(spark, csv_path)
        of_period(normalize.normalize(raw), period)  # refused before anything is written
        seen = Observation("extract rows")
        whole = whole_rows(raw.observe(seen, *broken_row_counts(raw)))
        marked = normalize.normalize(whole, unreadable_mask(whole).alias("unreadable"))
        write_report(marked, f"{out_path}/normalized")
        stored = spark.read.parquet(f"{out_path}/normalized")
        store("input_profile", lambda: normalize.input_profile(raw.drop(BROKEN_ROW), stored))
        # Tasks of a lost executor are observed twice; the stored rows tell.
        counted = seen.get["rows_read"] - seen.get["rows_broken"] == stored.count()
        store("dq_broken_rows", lambda: observed_row(spark, seen) if counted else broken_rows(raw))
        manifest.finish("normalized")
    marked = spark.read.parquet(f"{out_path}/normalized")
    normalized = marked.drop("unreadable")
    store("dq_unreadable_values", lambda: unreadable_values(marked))
    store("dq_null_profile", lambda: quality.null_profile(normalized))
    store("norm_drop_critical", lambda: normalize.drop_summary(normalized))

    clean = normalize.drop_incomplete(normalized)
    for name, report in frame_reports(of_period(clean, period), period).items():
        store(name, lambda report=report: report)

    store("model_frame", lambda: features.model_frame(clean), "parquet")
    split = features.stratified_split(spark.read.parquet(f"{out_path}/model_frame"))
    if not manifest.done("risk_model"):
        model.fit_risk_model(split).save(spark, f"{out_path}/risk_model")
        manifest.finish("risk_model")
    fitted = model.RiskModel.load(spark, f"{out_path}/risk_model")
    scored = model.score(fitted, split)
    scored_test = scored.where(F.col("is_test") == 1)
    coefficients = model.coefficients(fitted, spark)
    store("risk_scores", lambda: model.risk_scores(scored, token_secret))
    store("patient_risk", lambda: model.patient_risk(scored, token_secret))
    store("model_metrics", lambda: model.model_metrics(scored_test))
    store("classification_report", lambda: model.classification_report(scored_test))
    store("lr_coefficients", lambda: coefficients)
    store("risk_drivers", lambda: model.risk_drivers(coefficients))
    return fitted


def store_encounters(encounters: DataFrame, path: str) -> None:
    """The fact table at `path`, and at `path`_checks the counts its scorecard needs.

    The row checks are observed while the rows are written. Only the encounter numbers
    are read again, for their copies; a scorecard of the stored table costs no scan at all.
    """
    spark = encounters.sparkSession
    seen = Observation("encounter checks")
    write_encounters(encounters.observe(seen, *quality.row_check_counts()), path)
    stored = spark.read.parquet(path)
    copies = quality.surplus_copies(stored).first()
    counts = observed_row(spark, seen)
    if seen.get["total_rows"] != copies["total_rows"]:
        # Tasks of a lost executor are observed twice.
        counts = stored.agg(*quality.row_check_counts())
    counts = counts.withColumn("surplus_copies", F.lit(copies["surplus_copies"]).cast("bigint"))
    write_report(counts, f"{path}_checks")


def stored_scorecard(spark: SparkSession, path: str, **tolerances) -> DataFrame:
    """The scorecard of a table that `store_encounters` wrote, from its counts."""
    return quality.scorecard_of_counts(spark.read.parquet(f"{path}_checks"), **tolerances)


def add_month_batch(encounters: DataFrame, path: str, batch: str) -> None:
    """The states of a batch of new encounters, beside those of earlier batches.

    A batch has a folder of its own, so adding it again replaces it.
    """
    states = guarantee.month_states(encounters)
    write_report(states.totals, f"{path}/totals/batch={batch}")
    write_report(states.patients, f"{path}/patients/batch={batch}")


def read_month_states(spark: SparkSession, path: str) -> guarantee.MonthStates:
    """The states of all batches."""
    return guarantee.MonthStates(spark.read.parquet(f"{path}/totals"), spark.read.parquet(f"{path}/patients"))


def refresh_scorecard(encounters: DataFrame, state_path: str, batch: str, report_path: str) -> None:
    """Adds a batch of encounters to the monthly scorecard at `report_path`, one folder per month.

    Reads the new encounters and one row per month and batch. Only the months the batch
    touches, and the two rows after each, are written again.
    """
    spark = encounters.sparkSession
    add_month_batch(encounters, state_path, batch)
    scorecard = guarantee.scorecard_of_states(read_month_states(spark, state_path))
    touched = spark.read.parquet(f"{state_path}/totals/batch={batch}")
    changed = guarantee.changed_months(scorecard, touched)
    write_report(_by_month(changed), report_path, partition_by=("month",), keep_other_partitions=True)


def _by_month(scorecard: DataFrame) -> DataFrame:
    """With the folder of each row, so that a dashboard reads the months it shows."""
    return scorecard.withColumn("month", F.date_format("report_month", "yyyy-MM"))


def run_warehouse(
    encounters: DataFrame,
    dispositions: DataFrame,
    specialties: DataFrame,
    sources: DataFrame,
    out_path: str,
    file_format: str = "parquet",
    max_null_pct: float = 5.0,
    max_failed_pct: float = 0.0,
    period: str = ALL_ADMISSIONS,
    compared_dispositions: tuple[str, str] | None = None,
) -> list[str]:
    """Checks, then every report on the fact table. Returns the names written.

    The fact table may be the one `write_encounters` stored, read by `read_encounters`;
    a period then reads its months' folders only. `max_failed_pct` is the share of
    surplus or implausible rows that is accepted, none by default.

    The scorecard of the checks is always written; when one of them fails, nothing
    else is.
    """
    scorecard_path = f"{out_path}/dq_scorecard"
    write_report(
        quality.scorecard(encounters, max_null_pct=max_null_pct, max_failed_pct=max_failed_pct),
        scorecard_path,
    )
    checks = encounters.sparkSession.read.parquet(scorecard_path)
    failed = [row["check_name"] for row in checks.where(F.col("passed") == 0).collect()]
    if failed:
        raise QualityCheckFailed(f"failed checks: {', '.join(sorted(failed))}")
    reports = warehouse_reports(encounters, dispositions, specialties, sources, period, compared_dispositions)
    for name, report in reports.items():
        if name == "monthly_scorecard":
            write_report(_by_month(report), f"{out_path}/{name}", file_format, partition_by=("month",))
        else:
            write_report(report, f"{out_path}/{name}", file_format)
    return ["dq_scorecard", *reports]


def quarter_bounds(period: str) -> tuple:
    """First day of a period such as "Q4 2024" and of the one after it."""
    match = re.fullmatch(r"Q([1-4]) (\d{4})", period)
    if not match:
        raise ValueError(f"not a quarter: {period!r}, expected e.g. 'Q1 2020'")
    quarter, year = int(match[1]), int(match[2])
    first = datetime.date(year, 3 * quarter - 2, 1)
    after = datetime.date(year + quarter // 4, 3 * quarter % 12 + 1, 1)
    return first, after


def admitted_in(period: str) -> Column:
    """Whether an encounter was admitted in a quarter."""
    first, after = quarter_bounds(period)
    return (F.col("admission_date") >= F.lit(first)) & (F.col("admission_date") < F.lit(after))


def in_quarter(encounters: DataFrame, period: str) -> DataFrame:
    """Encounters admitted in a quarter; prunes the month folders of a stored table."""
    first, after = quarter_bounds(period)
    within = encounters.where(admitted_in(period))
    if "admission_month" in encounters.columns:
        month = F.col("admission_month")
        within = within.where((month >= F.lit(first)) & (month < F.lit(after)))
    return within
