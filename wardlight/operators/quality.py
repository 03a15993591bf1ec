"""Data-quality checks run before any report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.fixed_values import AGE_MAX, AGE_MIN
from wardlight.functions.measures import rate_pct, readmissions_30d, rounded_pct
from wardlight.operators.one_row import OneRow, alone

_NULL_CHECKS = (
    ("null_patient_id", "patient_id"),
    ("null_age", "age"),
    ("null_diagnosis", "primary_diagnosis"),
    ("null_readmitted", "readmitted"),
    ("null_discharge", "discharge_disposition"),
)


def null_counts_part() -> OneRow:
    counts = {name: F.sum(F.when(F.col(column).isNull(), 1)) for name, column in _NULL_CHECKS}
    rate = rounded_pct(readmissions_30d(), F.count("*"))
    return OneRow({"total_records": F.count("*"), **counts, "readmission_rate_pct": rate}, lambda row: row)


def null_counts(encounters: DataFrame) -> DataFrame:
    """One row: records, NULLs per critical column, 30-day rate.

    A column without a single NULL reports NULL, not 0.
    """
    return alone(encounters, null_counts_part())


def implausible_ages(encounters: DataFrame) -> DataFrame:
    """Records with an impossible age, per age group; unknown ages are not listed."""
    return (
        encounters.where(~F.col("age").between(AGE_MIN, AGE_MAX))
        .groupBy("age_group")
        .agg(
            F.count("*").alias("record_count"),
            F.min("time_in_hospital").alias("min_los"),
            F.max("time_in_hospital").alias("max_los"),
            F.avg("time_in_hospital").alias("avg_los"),
        )
        .orderBy(F.col("age_group").asc_nulls_last())
    )


def duplicate_encounters(encounters: DataFrame) -> DataFrame:
    """Encounter numbers that occur more than once."""
    return (
        encounters.groupBy("encounter_id")
        .agg(F.count("*").alias("duplicate_count"))
        .where(F.col("duplicate_count") > 1)
    )


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count and share of every column that has any, from a single scan."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{name}`").isNull()).alias(name) for name in df.columns],
    )
    return (
        counted.unpivot("_rows", list(df.columns), "column_name", "null_count")
        .where(F.col("null_count") > 0)
        .select(
            "column_name",
            "null_count",
            rate_pct(F.col("null_count"), F.col("_rows")).alias("null_pct"),
        )
    )


def row_check_counts() -> list[Column]:
    """The aggregates of the checks that look at one row at a time; they can be observed during a write."""
    return [
        F.count("*").alias("total_rows"),
        *[F.count_if(F.col(column).isNull()).alias(name) for name, column in _NULL_CHECKS],
        F.count_if(~F.col("age").between(AGE_MIN, AGE_MAX)).alias("age_out_of_range"),
    ]


def surplus_copies(encounters: DataFrame) -> DataFrame:
    """One row: all rows, and those that repeat an encounter number.

    Reads the encounter number only, and ships one (id, count) per task and id.
    """
    return (
        encounters.groupBy("encounter_id")
        .agg(F.count("*").alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_copies"),
        )
    )


def scorecard(
    encounters: DataFrame,
    max_null_pct: float = 5.0,
    max_null_pct_by_column: dict | None = None,
    max_failed_pct: float = 0.0,
) -> DataFrame:
    """Eight named checks with the rows that fail, the tolerance and the verdict.

    Five NULL checks, each against the null threshold of its column; implausible
    ages and surplus copies of an encounter against `max_failed_pct`; and the
    number of critical columns above their null threshold, which must be zero.
    """
    counts = encounters.agg(*row_check_counts())
    return _judged(counts, surplus_copies(encounters), max_null_pct, max_null_pct_by_column, max_failed_pct)


def scorecard_of_counts(
    counts: DataFrame,
    max_null_pct: float = 5.0,
    max_null_pct_by_column: dict | None = None,
    max_failed_pct: float = 0.0,
) -> DataFrame:
    """The scorecard from one row that holds the counts and `surplus_copies`, as a stored table keeps them."""
    copies = counts.select("total_rows", "surplus_copies")
    return _judged(counts, copies, max_null_pct, max_null_pct_by_column, max_failed_pct)


def _judged(
    row_checks: DataFrame, copies: DataFrame, max_null_pct: float, by_column: dict | None, max_failed_pct: float
) -> DataFrame:
    thresholds = {column: max_null_pct for _, column in _NULL_CHECKS}
    thresholds.update(by_column or {})
    over_threshold = sum(
        (
            F.coalesce(
                rate_pct(F.col(name), F.col("total_rows")) > thresholds[column], F.lit(False)
            ).cast("bigint")
            for name, column in _NULL_CHECKS
        ),
        F.lit(0).cast("bigint"),
    )
    row_checks = row_checks.withColumn("null_rate_thresholds", over_threshold)
    per_row = row_checks.unpivot(
        "total_rows",
        [name for name, _ in _NULL_CHECKS] + ["age_out_of_range", "null_rate_thresholds"],
        "check_name",
        "failed",
    )
    copies = copies.select(
        "total_rows", F.lit("duplicate_encounters").alias("check_name"), F.col("surplus_copies").alias("failed")
    )
    limit = F.lit(float(max_failed_pct))
    for name, column in _NULL_CHECKS:
        limit = F.when(F.col("check_name") == name, float(thresholds[column])).otherwise(limit)
    failed_pct = F.when(
        F.col("check_name") != "null_rate_thresholds",
        rounded_pct(F.col("failed"), F.col("total_rows"), 4),
    )
    within = F.when(
        F.col("check_name") == "null_rate_thresholds", F.col("failed") == 0
    ).otherwise(F.coalesce(rate_pct(F.col("failed"), F.col("total_rows")) <= limit, F.lit(True)))
    return per_row.unionByName(copies).select(
        "check_name",
        "failed",
        "total_rows",
        failed_pct.alias("failed_pct"),
        limit.alias("threshold_pct"),
        within.cast("int").alias("passed"),
    )
