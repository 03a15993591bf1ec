import numpy as np
import pytest

from tests.helpers import group, make_encounters, make_raw, rows_by
from wardlight.operators import descriptive
from wardlight.operators.normalize import normalize


def test_kpi_summary(spark):
    row = descriptive.kpi_summary(
        make_encounters(
            spark,
            {"readmitted": "<30", "time_in_hospital": 1, "times": 2},
            {"readmitted": ">30", "patient_id": 2, "time_in_hospital": None},
            {"readmitted": None, "patient_id": None},
        )
    ).first()
    assert (row["unique_patients"], row["total_encounters"]) == (2, 4)
    assert row["avg_length_of_stay"] == 1.67
    assert (row["readmissions_30day"], row["readmissions_after_30"]) == (2, 1)
    assert row["no_readmission"] == 0
    assert row["readmission_rate_30day_pct"] == 50.0


def test_means_round_exact_ties_up(spark):
    # 201 / 200 = 1.005 has no exact double.
    frame = make_encounters(spark, {"time_in_hospital": 1, "times": 199}, {"time_in_hospital": 2})
    assert descriptive.kpi_summary(frame).first()["avg_length_of_stay"] == 1.01


def test_quarters_sort_unknown_dates_last(spark):
    import datetime

    rows = descriptive.quarterly_trend(
        make_encounters(
            spark,
            {"admission_date": None},
            {"admission_date": datetime.datetime(2020, 12, 31)},
            {"admission_date": datetime.datetime(2020, 1, 1)},
            {"admission_date": datetime.datetime(2019, 7, 1)},
        )
    ).collect()
    assert [(row["year"], row["quarter"]) for row in rows] == [
        (2019, 3),
        (2020, 1),
        (2020, 4),
        (None, None),
    ]


def test_distribution_shares_cover_unknown_outcomes(spark):
    outcomes = ("NO", "NO", "?", "<30")
    frame = normalize(make_raw(spark, *[{"readmitted": outcome} for outcome in outcomes]))
    rows = descriptive.readmission_distribution(frame).collect()
    assert [(row["readmitted"], row["encounters"], row["share_pct"]) for row in rows] == [
        ("NO", 2, 50.0),
        ("<30", 1, 25.0),
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_box_stats_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    stays = np.concatenate([rng.integers(2, 9, 60), [30, 40, 0]])
    frame = normalize(
        make_raw(spark, *[{"time_in_hospital": int(day), "readmitted": ">30"} for day in stays])
    )
    row = descriptive.los_box_stats(frame).first()
    q1, median, q3 = np.percentile(stays, [25, 50, 75])
    inside = stays[(stays >= q1 - 1.5 * (q3 - q1)) & (stays <= q3 + 1.5 * (q3 - q1))]
    assert row["outcome"] == ">30 Days"
    assert (row["q1"], row["median"], row["q3"]) == (q1, median, q3)
    assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
    assert row["outliers"] == len(stays) - len(inside)
    assert row["notch_high"] == pytest.approx(median + 1.57 * (q3 - q1) / np.sqrt(len(stays)))


def test_whisker_stays_outside_the_box(spark):
    # Nothing lies between the upper quartile (interpolated) and the fence.
    frame = normalize(
        make_raw(spark, *[{"time_in_hospital": day, "readmitted": "NO"} for day in (1, 1, 1, 9)])
    )
    row = descriptive.los_box_stats(frame).first()
    assert row["q3"] == 3.0 and row["whisker_high"] == 3.0 and row["outliers"] == 1


def test_age_panel_keeps_empty_bands_and_overall(spark):
    frame = normalize(
        make_raw(
            spark,
            *group(2, 10, age_group="[10-20)"),
            *group(0, 5, age_group="[90-100)"),
            *group(5, 5, age_group="unknown"),
        )
    )
    rows = descriptive.age_rate_panel(frame).collect()
    assert [row["band_order"] for row in rows] == list(range(10))
    assert (rows[1]["rate"], rows[1]["above_alert"], rows[1]["label"]) == (0.2, 1, "10-20")
    assert rows[0]["rate"] is None and rows[0]["encounters"] is None and rows[0]["above_alert"] == 0
    assert {row["overall_rate"] for row in rows} == {7 / 20}


def test_age_panel_of_nothing_has_ten_bands(spark):
    frame = normalize(make_raw(spark, {}).limit(0))
    assert descriptive.age_rate_panel(frame).count() == 10


def test_medication_curve_is_right_closed(spark):
    readmitted = {"readmitted": "<30"}
    frame = normalize(
        make_raw(
            spark,
            {"num_medications": 0, **readmitted},
            {"num_medications": 1},
            {"num_medications": 5, **readmitted},
            {"num_medications": 6},
            {"num_medications": 20, **readmitted},
            {"num_medications": 100},
            {"num_medications": 101, **readmitted},
            {"num_medications": None, **readmitted},
        )
    )
    rows = rows_by(descriptive.medication_curve(frame), "medication_bin")
    rates = {name: row["readmission_rate_pct"] for name, row in rows.items()}
    assert rates == {"1-5": 50.0, "6-10": 0.0, "11-15": None, "16-20": 100.0, "20+": 0.0}


def test_kpi_list(spark):
    frame = normalize(make_raw(spark, {"readmitted": "<30"}, {"readmitted": "?", "patient_id": 2}))
    values = {row["kpi"]: row["value"] for row in descriptive.kpi_list(frame).collect()}
    assert len(values) == 7
    assert values["Unique Patients"] == 2.0
    assert values["30-Day Readmission Rate"] == 50.0
    assert values["Any Readmission Rate"] == 100.0
