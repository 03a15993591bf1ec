import pytest
from pyspark.sql import functions as F

from tests.helpers import make_raw, rows_by
from wardlight.operators.normalize import (
    drop_incomplete,
    drop_summary,
    input_profile,
    normalize,
)


def _one(spark, **values):
    return normalize(make_raw(spark, values)).first()


def test_missing_outcome_is_no_30_day_but_any_readmission(spark):
    row = _one(spark, readmitted="?")
    assert row["readmitted"] is None
    assert (row["readmitted_30d"], row["readmitted_any"]) == (0, 1)


@pytest.mark.parametrize(
    "outcome, flags", [("<30", (1, 1)), (">30", (0, 1)), ("NO", (0, 0)), (None, (0, 1))]
)
def test_outcome_flags(spark, outcome, flags):
    row = _one(spark, readmitted=outcome)
    assert (row["readmitted_30d"], row["readmitted_any"]) == flags


def test_zero_denominators_count_as_one(spark):
    row = _one(
        spark, time_in_hospital=0, num_lab_procedures=12, num_diagnoses=0, num_medications=9
    )
    assert (row["labs_per_day"], row["meds_per_diagnosis"]) == (12.0, 9.0)


def test_missing_denominator_gives_no_ratio(spark):
    row = _one(spark, time_in_hospital=None, num_diagnoses=None)
    assert row["labs_per_day"] is None and row["meds_per_diagnosis"] is None
    assert row["complex_patient"] == 0


@pytest.mark.parametrize(
    "result, flag", [("None", 0), (None, 0), ("?", 0), ("Norm", 1), (">7", 1), ("other", 1)]
)
def test_a1c_flag(spark, result, flag):
    assert _one(spark, a1c_result=result)["has_a1c_result"] == flag


@pytest.mark.parametrize("count, flag", [(4, 0), (5, 1), (None, 0)])
def test_complex_patient(spark, count, flag):
    assert _one(spark, num_diagnoses=count)["complex_patient"] == flag


@pytest.mark.parametrize("count, flag", [(14, 0), (15, 1), (None, 0)])
def test_polypharmacy(spark, count, flag):
    assert _one(spark, num_medications=count)["polypharmacy_flag"] == flag


@pytest.mark.parametrize(
    "band, midpoint", [("[0-10)", 5), ("[90-100)", 95), ("?", None), (None, None), ("85", None)]
)
def test_age_midpoint(spark, band, midpoint):
    assert _one(spark, age_group=band)["age_numeric"] == midpoint


def test_missing_flag_inputs_are_zero(spark):
    row = _one(spark, change=None, diabetesMed="?")
    assert (row["medication_changed"], row["on_diabetes_med"]) == (0, 0)


def test_either_name_of_the_diagnosis_count(spark):
    raw = make_raw(spark, {"num_diagnoses": 6})
    other_name = raw.withColumnRenamed("number_diagnoses", "num_diagnoses")
    both = raw.withColumn("num_diagnoses", F.lit(99)).withColumn(
        "number_diagnoses", F.lit(None).cast("int")
    )
    assert normalize(other_name).first()["num_diagnoses"] == 6
    assert normalize(both).first()["num_diagnoses"] == 99


def test_text_numbers_are_typed_and_markers_dropped(spark):
    raw = make_raw(spark, {}, {}, {})
    text = raw.withColumn(
        "num_medications",
        F.get(F.array(F.lit("12"), F.lit("?"), F.lit("x")), F.col("encounter_id").cast("int") - 1),
    )
    rows = rows_by(normalize(text), "encounter_id")
    assert [rows[i]["num_medications"] for i in (1, 2, 3)] == [12, None, None]


def test_absent_column_is_an_error(spark):
    with pytest.raises(ValueError, match="change"):
        normalize(make_raw(spark, {}).drop("change"))


def test_drop_summary_matches_the_dropped_frame(spark):
    normalized = normalize(
        make_raw(
            spark,
            {"readmitted": "<30"},
            {"age_group": "?"},
            {"time_in_hospital": None, "readmitted": "<30"},
            {"num_medications": None},
            {"num_diagnoses": None},
        )
    )
    summary = drop_summary(normalized).first()
    assert (summary["records_before"], summary["records_removed"]) == (5, 3)
    assert summary["records_after"] == drop_incomplete(normalized).count() == 2
    assert summary["readmission_rate_pct"] == 50.0


def test_empty_extract(spark):
    raw = make_raw(spark, {}).limit(0)
    assert input_profile(raw).first()["records"] == 0
    summary = drop_summary(normalize(raw)).first()
    assert summary["records_after"] == 0 and summary["readmission_rate_pct"] is None


def test_input_profile_counts_the_columns_of_the_extract(spark):
    raw = make_raw(spark, {}, {}).withColumn("unused", F.lit(1))
    assert tuple(input_profile(raw).first()) == (2, 14)
