"""Normalization of a raw extract into analysable encounters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    A1C_NOT_MEASURED,
    COMPLEX_DIAGNOSES,
    CRITICAL_COLUMNS,
    MEDICATION_CHANGED,
    NOT_READMITTED,
    ON_DIABETES_MEDICATION,
    POLYPHARMACY_MEDICATIONS,
    READMITTED_WITHIN_30,
)
from wardlight.functions.banding import age_midpoint
from wardlight.functions.flags import (
    all_known,
    flag_at_least,
    flag_equal,
    flag_known_and_not,
    flag_not_equal,
    ratio_zero_as_one,
)
from wardlight.functions.measures import rate_pct
from wardlight.schema import canonicalize


def normalize(raw: DataFrame, *extra: Column) -> DataFrame:
    """Canonical names and types plus every derived column; keeps all rows.

    `extra` columns of the raw extract are carried along.
    """
    return canonicalize(raw, *extra).withColumns(
        {
            "age_numeric": age_midpoint(F.col("age_group")),
            "readmitted_30d": flag_equal("readmitted", READMITTED_WITHIN_30),
            # An unknown outcome counts as "any readmission".
            "readmitted_any": flag_not_equal("readmitted", NOT_READMITTED),
            "medication_changed": flag_equal("change", MEDICATION_CHANGED),
            "on_diabetes_med": flag_equal("diabetesMed", ON_DIABETES_MEDICATION),
            "has_a1c_result": flag_known_and_not("a1c_result", A1C_NOT_MEASURED),
            "labs_per_day": ratio_zero_as_one("num_lab_procedures", "time_in_hospital"),
            "meds_per_diagnosis": ratio_zero_as_one("num_medications", "num_diagnoses"),
            "complex_patient": flag_at_least("num_diagnoses", COMPLEX_DIAGNOSES),
            "polypharmacy_flag": flag_at_least("num_medications", POLYPHARMACY_MEDICATIONS),
        }
    )


def drop_incomplete(normalized: DataFrame) -> DataFrame:
    """Only encounters whose critical columns are all known."""
    return normalized.where(all_known(CRITICAL_COLUMNS))


def input_profile(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Size of the input: records and columns.

    A frame that holds every row of the extract, where given, is counted in its place.
    """
    counted = raw if stored is None else stored
    return counted.agg(F.count("*").alias("records")).withColumn("features", F.lit(len(raw.columns)))


def drop_summary(normalized: DataFrame) -> DataFrame:
    """Rows before, removed and after `drop_incomplete`, and the rate that remains.

    One pass: the kept rows are counted, not filtered and scanned again.
    """
    kept = all_known(CRITICAL_COLUMNS)
    counted = normalized.agg(
        F.count("*").alias("records_before"),
        F.count_if(kept).alias("records_after"),
        F.coalesce(F.sum(F.when(kept, F.col("readmitted_30d"))), F.lit(0)).alias("_readmitted"),
    )
    return counted.select(
        "records_before",
        (F.col("records_before") - F.col("records_after")).alias("records_removed"),
        "records_after",
        rate_pct(F.col("_readmitted"), F.col("records_after")).alias("readmission_rate_pct"),
    )
