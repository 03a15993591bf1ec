"""Reports against the contractual 30-day target."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    MONTH_STATUS,
    NEAR_TARGET_RATE_PCT,
    PERIOD_STATUS,
    TARGET_RATE_PCT,
)
from wardlight.functions.measures import (
    rate_pct,
    readmissions_30d,
    rounded_mean,
    rounded_pct,
    rounded_ratio,
)
from wardlight.operators.one_row import OneRow, alone, rows_within, value_within


def monthly_totals(encounters: DataFrame, densify: bool = False) -> DataFrame:
    """One row per admission month, and with `densify` also per month without any."""
    totals = encounters.groupBy(_month().alias("report_month")).agg(
        F.count("*").alias("total_admissions"),
        readmissions_30d().alias("readmissions_30d"),
        rounded_mean("time_in_hospital").alias("avg_los"),
        rounded_mean("num_medications").alias("avg_medications"),
        F.countDistinct("patient_id").alias("unique_patients"),
    )
    return _densified(totals) if densify else totals


def _month() -> Column:
    """The admission month; truncated as a date, so that no session time zone gets involved."""
    return F.trunc(F.col("admission_date").cast("date"), "month").cast("timestamp_ntz")


def _densified(totals: DataFrame) -> DataFrame:
    spine = totals.agg(
        F.min("report_month").alias("first"), F.max("report_month").alias("last")
    ).select(
        F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("spine_month")
    )
    # A full join keeps the row of unknown admission months.
    return (
        totals.join(spine, F.col("report_month") == F.col("spine_month"), "full")
        .withColumn("report_month", F.coalesce("report_month", "spine_month"))
        .withColumns(
            {
                name: F.coalesce(name, F.lit(0))
                for name in ("total_admissions", "readmissions_30d", "unique_patients")
            }
        )
        .drop("spine_month")
    )


def monthly_scorecard(
    encounters: DataFrame,
    target_pct: float = TARGET_RATE_PCT,
    near_pct: float = NEAR_TARGET_RATE_PCT,
    densify: bool = False,
) -> DataFrame:
    """Monthly rate with its change, three-row rolling mean and target status.

    Change and rolling mean look at the preceding rows: without `densify` a month
    nobody was admitted in is passed over. Encounters without an admission date
    form a last row.
    """
    return _rated_months(monthly_totals(encounters, densify), target_pct, near_pct, densify)


@dataclass(frozen=True)
class MonthStates:
    """What months need to be merged: sums and counts, and their patients as bitmaps.

    A bitmap stands for 32768 consecutive patient numbers, so the union of two sets of
    patients, and its size, are exact without the encounters.
    """

    totals: DataFrame  # (report_month, sums and counts)
    patients: DataFrame  # (report_month, bucket, bitmap)


_STATE_SUMS = ("total_admissions", "readmissions_30d", "stay_sum", "stay_rows", "medication_sum", "medication_rows")


def month_states(encounters: DataFrame) -> MonthStates:
    """The states of the months that the encounters touch."""
    by_month = encounters.withColumn("report_month", _month())
    totals = by_month.groupBy("report_month").agg(
        F.count("*").alias("total_admissions"),
        readmissions_30d().alias("readmissions_30d"),
        F.sum(F.col("time_in_hospital").cast("bigint")).alias("stay_sum"),
        F.count("time_in_hospital").alias("stay_rows"),
        F.sum(F.col("num_medications").cast("bigint")).alias("medication_sum"),
        F.count("num_medications").alias("medication_rows"),
    )
    patients = (
        by_month.where(F.col("patient_id").isNotNull())
        .groupBy("report_month", F.bitmap_bucket_number("patient_id").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("patient_id")).alias("bitmap"))
    )
    return MonthStates(totals, patients)


def merged_states(states: MonthStates) -> MonthStates:
    """One state per month, from states of several batches of encounters put together."""
    return MonthStates(
        states.totals.groupBy("report_month").agg(*[F.sum(name).alias(name) for name in _STATE_SUMS]),
        states.patients.groupBy("report_month", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")),
    )


def scorecard_of_states(
    states: MonthStates,
    target_pct: float = TARGET_RATE_PCT,
    near_pct: float = NEAR_TARGET_RATE_PCT,
    densify: bool = False,
) -> DataFrame:
    """`monthly_scorecard` from the states of batches that make up the encounters."""
    merged = merged_states(states)
    patients = merged.patients.groupBy(F.col("report_month").alias("_month")).agg(
        F.sum(F.bitmap_count("bitmap")).alias("unique_patients")
    )

    def mean(total: str, rows: str) -> Column:
        return rounded_ratio(F.col(total), F.col(rows))

    # The join is over months. The unknown month meets itself.
    totals = merged.totals.join(patients, F.col("report_month").eqNullSafe(F.col("_month")), "left").select(
        "report_month",
        "total_admissions",
        "readmissions_30d",
        mean("stay_sum", "stay_rows").alias("avg_los"),
        mean("medication_sum", "medication_rows").alias("avg_medications"),
        F.coalesce("unique_patients", F.lit(0)).alias("unique_patients"),
    )
    return _rated_months(_densified(totals) if densify else totals, target_pct, near_pct, densify)


def changed_months(scorecard: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of a scorecard that new encounters in the `touched` months (report_month) can change.

    A row's change looks one row back and its rolling mean two, so they are the touched rows
    and the two after each.
    """
    marks = touched.select(F.col("report_month").alias("_touched"), F.lit(1).alias("_mark")).distinct()
    marked = scorecard.join(marks, F.col("report_month").eqNullSafe(F.col("_touched")), "left")
    last_three = W.orderBy(F.asc_nulls_last("report_month")).rowsBetween(-2, W.currentRow)
    return (
        marked.withColumn("_near", F.max("_mark").over(last_three))
        .where("_near = 1")
        .drop("_touched", "_mark", "_near")
    )


def _rated_months(totals: DataFrame, target_pct: float, near_pct: float, densify: bool) -> DataFrame:
    rated = totals.withColumn(
        "_rate", rate_pct(F.col("readmissions_30d"), F.col("total_admissions"))
    )
    # The windows run over months, never over encounters.
    by_month = W.orderBy(F.asc_nulls_last("report_month"))
    previous = F.lag("_rate").over(by_month)
    status = (
        F.when(F.col("_rate") <= target_pct, MONTH_STATUS[0])
        .when(F.col("_rate") <= near_pct, MONTH_STATUS[1])
        .otherwise(MONTH_STATUS[2])
    )
    if densify:
        status = F.when(F.col("_rate").isNotNull(), status)
    return rated.select(
        "report_month",
        "total_admissions",
        "readmissions_30d",
        rounded_pct(F.col("readmissions_30d"), F.col("total_admissions")).alias(
            "readmission_rate_pct"
        ),
        "avg_los",
        "avg_medications",
        "unique_patients",
        previous.alias("prev_month_rate"),
        F.round(F.col("_rate") - previous, 2).alias("rate_change_mom"),
        F.round(F.avg("_rate").over(by_month.rowsBetween(-2, W.currentRow)), 2).alias(
            "rolling_3mo_avg"
        ),
        status.alias("performance_status"),
    ).orderBy(F.asc_nulls_last("report_month"))


def period_guarantee_part(period: str, target_pct: float = TARGET_RATE_PCT, within: Column | None = None) -> OneRow:
    """The contract summary of the rows for which `within` holds."""
    rows = rows_within(within)
    measures = {
        "readmission_rate_30day_pct": rate_pct(F.sum(value_within("readmitted_30d", within)), rows),
        "readmission_rate_any_pct": rate_pct(F.sum(value_within("readmitted_any", within)), rows),
        "avg_length_of_stay": F.avg(value_within("time_in_hospital", within)),
        "avg_medications": F.avg(value_within("num_medications", within)),
    }
    met = F.col("readmission_rate_30day_pct") <= target_pct
    return OneRow(
        measures,
        lambda row: row.select(
            F.lit(period).alias("period"),
            "readmission_rate_30day_pct",
            F.lit(float(target_pct)).alias("target_rate_pct"),
            F.when(met, PERIOD_STATUS[0]).otherwise(PERIOD_STATUS[1]).alias("status"),
            "readmission_rate_any_pct",
            "avg_length_of_stay",
            "avg_medications",
        ),
    )


def period_guarantee(
    clean: DataFrame, period: str, target_pct: float = TARGET_RATE_PCT
) -> DataFrame:
    """One row for a reporting period: rates, averages, target and status.

    The caller passes the encounters of that period; `period` is its name.
    """
    return alone(clean, period_guarantee_part(period, target_pct))
