from tests.helpers import make_encounters, make_raw, rows_by
from wardlight.operators import quality
from wardlight.operators.normalize import normalize


def test_column_without_nulls_reports_null(spark):
    row = quality.null_counts(
        make_encounters(spark, {"patient_id": None}, {"patient_id": None}, {"readmitted": "<30"})
    ).first()
    assert row["null_patient_id"] == 2
    assert row["null_age"] is None
    assert row["readmission_rate_pct"] == 33.33


def test_null_counts_of_nothing(spark):
    row = quality.null_counts(make_encounters(spark, {}).limit(0)).first()
    assert row["total_records"] == 0 and row["readmission_rate_pct"] is None


def test_implausible_ages_exclude_bounds_and_unknown(spark):
    rows = quality.implausible_ages(
        make_encounters(
            spark,
            {"age": 0},
            {"age": 120},
            {"age": None},
            {"age": 121, "time_in_hospital": 2},
            {"age": -1, "time_in_hospital": 5},
            {"age": 130, "age_group": None},
        )
    ).collect()
    assert [(row["age_group"], row["record_count"]) for row in rows] == [("[50-60)", 2), (None, 1)]
    assert (rows[0]["min_los"], rows[0]["max_los"], rows[0]["avg_los"]) == (2, 5, 3.5)


def test_duplicates(spark):
    frame = make_encounters(
        spark, {"encounter_id": 7, "times": 3}, {"encounter_id": 8}, {"encounter_id": 9, "times": 2}
    )
    rows = rows_by(quality.duplicate_encounters(frame), "encounter_id")
    assert {key: row["duplicate_count"] for key, row in rows.items()} == {7: 3, 9: 2}


def test_null_profile_lists_only_columns_with_nulls(spark):
    frame = normalize(make_raw(spark, {"readmitted": "?"}, {"age_group": None}, {}, {}))
    profile = rows_by(quality.null_profile(frame), "column_name")
    assert set(profile) == {"readmitted", "age_group", "age_numeric"}
    assert profile["readmitted"]["null_pct"] == 25.0


def test_scorecard_has_eight_checks(spark):
    frame = make_encounters(
        spark,
        {"times": 8},
        {"patient_id": None},
        {"age": 200, "encounter_id": 1},
    )
    card = rows_by(quality.scorecard(frame, max_null_pct=5.0), "check_name")
    assert len(card) == 8
    assert (card["null_patient_id"]["failed"], card["null_patient_id"]["passed"]) == (1, 0)
    assert (card["null_age"]["failed"], card["null_age"]["passed"]) == (0, 1)
    for name in ("age_out_of_range", "duplicate_encounters", "null_rate_thresholds"):
        assert (card[name]["failed"], card[name]["passed"]) == (1, 0)


def test_scorecard_threshold_is_inclusive_and_per_column(spark):
    frame = make_encounters(spark, {"times": 9}, {"patient_id": None})
    exact = rows_by(quality.scorecard(frame, max_null_pct=10.0), "check_name")
    assert exact["null_patient_id"]["passed"] == 1
    strict = rows_by(
        quality.scorecard(frame, 10.0, max_null_pct_by_column={"patient_id": 9.0}), "check_name"
    )
    assert strict["null_patient_id"]["passed"] == 0


def test_scorecard_of_nothing_passes(spark):
    card = quality.scorecard(make_encounters(spark, {}).limit(0)).collect()
    assert len(card) == 8 and all(row["passed"] == 1 for row in card)
