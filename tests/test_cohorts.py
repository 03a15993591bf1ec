import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import group, make_encounters, make_raw, rows_by
from wardlight.fixed_values import CORRELATED_COLUMNS, RISK_FLAGS, RISK_LEVELS
from wardlight.operators import cohorts, findings
from wardlight.operators.normalize import normalize


def test_diagnosis_flags_at_exact_cuts(spark):
    frame = make_encounters(
        spark,
        *group(20, 100, primary_diagnosis="high"),
        *group(12, 100, primary_diagnosis="moderate"),
        *group(119, 1000, primary_diagnosis="low"),
        *group(50, 99, primary_diagnosis="small"),
    )
    rows = cohorts.diagnosis_risk(frame).collect()
    assert [row["primary_diagnosis"] for row in rows] == ["high", "moderate", "low"]
    assert [row["risk_flag"] for row in rows] == list(RISK_FLAGS)
    assert [row["readmission_rate_pct"] for row in rows] == [20.0, 12.0, 11.9]


def test_unknown_diagnosis_is_a_cohort_in_one_variant_only(spark):
    rows = group(30, 100, primary_diagnosis=None)
    assert cohorts.diagnosis_risk(make_encounters(spark, *rows)).count() == 1
    assert cohorts.diagnosis_stats(normalize(make_raw(spark, *rows))).count() == 0


def test_tied_diagnoses_keep_a_fixed_order(spark):
    frame = make_encounters(
        spark, *[row for name in "dbca" for row in group(10, 100, primary_diagnosis=name)]
    )
    kept = [row["primary_diagnosis"] for row in cohorts.diagnosis_risk(frame, top=3).collect()]
    assert kept == ["a", "b", "c"]


def test_diagnosis_stats_levels(spark):
    frame = normalize(
        make_raw(
            spark,
            *group(40, 200, primary_diagnosis="a"),
            *group(24, 200, primary_diagnosis="b"),
            *group(1, 200, primary_diagnosis="c"),
        )
    )
    rows = cohorts.diagnosis_stats(frame).collect()
    assert [row["risk_level"] for row in rows] == list(RISK_LEVELS)
    assert [row["readmission_rate"] for row in rows] == [0.2, 0.12, 0.005]
    assert cohorts.diagnosis_stats(frame, top=1).count() == 1


def test_opportunities_flag_at_the_threshold(spark):
    frame = make_encounters(
        spark,
        *group(15, 100, primary_diagnosis="a", age_group="[10-20)"),
        *group(14, 100, primary_diagnosis="b", age_group="[10-20)"),
        *group(15, 100, primary_diagnosis="c", age_group=None),
    )
    rows = cohorts.service_opportunities(frame, dimensions=("primary_diagnosis", "age_group"))
    diagnoses = {
        row["cohort"]: (row["opportunity_rank"], row["intervention_flag"])
        for row in rows.collect()
        if row["dimension"] == "primary_diagnosis"
    }
    assert diagnoses == {"a": (1, 1), "c": (1, 1), "b": (3, 0)}
    flagged = cohorts.service_opportunities(
        frame, dimensions=("primary_diagnosis",), flagged_only=True
    )
    assert {row["cohort"] for row in flagged.collect()} == {"a", "c"}


def test_age_ranks_leave_gaps(spark):
    frame = make_encounters(
        spark,
        *group(2, 10, age_group="[0-10)"),
        *group(4, 20, age_group="[10-20)"),
        *group(1, 10, age_group="[20-30)"),
    )
    ranks = {r["age_group"]: r["risk_rank"] for r in cohorts.age_cohort_rank(frame).collect()}
    assert ranks == {"[0-10)": 1, "[10-20)": 1, "[20-30)": 3}


def test_medication_tiers_are_left_closed_and_complete(spark):
    counts = (0, 4, 5, 9, 10, 14, 15, 19, 20, 200, None)
    frame = make_encounters(spark, *[{"num_medications": count} for count in counts])
    rows = cohorts.medication_tiers(frame).collect()
    assert [(row["medication_tier"], row["patient_count"]) for row in rows] == [
        ("1-4 medications", 2),
        ("5-9 medications", 2),
        ("10-14 medications", 2),
        ("15-19 medications", 2),
        ("20+ medications", 3),
    ]


def _measurements(seed=7, rows=80):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            name: rng.normal(50, 10, rows) if name == "labs_per_day" else rng.integers(0, 40, rows)
            for name in CORRELATED_COLUMNS
        }
    ).astype(float)


def test_correlations_against_pandas_with_missing_values(spark):
    data = _measurements()
    data.loc[data.index % 7 == 0, "num_procedures"] = np.nan
    data.loc[data.index % 5 == 1, "labs_per_day"] = np.nan
    rows = [tuple(None if np.isnan(v) else v for v in row) for row in data.to_numpy().tolist()]
    schema = ", ".join(f"{name} double" for name in data.columns)
    pairs = cohorts.correlation_pairs(spark.createDataFrame(rows, schema)).collect()
    expected = data.corr()
    assert len(pairs) == 36
    for row in pairs:
        assert row["corr"] == pytest.approx(expected.loc[row["x"], row["y"]], abs=1e-10)
        assert CORRELATED_COLUMNS.index(row["x"]) > CORRELATED_COLUMNS.index(row["y"])


def test_constant_and_unknown_columns_have_no_correlation(spark):
    data = _measurements()
    data["num_procedures"] = 0.1
    rows = [(*row[:2], None, *row[3:]) for row in data.to_numpy().tolist()]
    schema = ", ".join(f"{name} double" for name in data.columns)
    pairs = cohorts.correlation_pairs(spark.createDataFrame(rows, schema)).collect()
    for row in pairs:
        no_value = {"num_procedures", "num_lab_procedures"} & {row["x"], row["y"]}
        assert (row["corr"] is None) == bool(no_value)


def test_polypharmacy_ratio(spark):
    frame = normalize(
        make_raw(spark, *group(3, 10, num_medications=20), *group(1, 10, num_medications=19))
    )
    row = findings.polypharmacy_ratio(frame).first()
    assert (row["polypharmacy_rate_pct"], row["other_rate_pct"]) == (30.0, 10.0)
    assert row["rate_ratio"] == 3.0


def test_ratio_without_comparison_is_null(spark):
    frame = normalize(make_raw(spark, *group(3, 10, num_medications=20)))
    assert findings.polypharmacy_ratio(frame).first()["rate_ratio"] is None


def test_top_diagnosis_share(spark):
    frame = normalize(
        make_raw(
            spark,
            *[row for i in range(1, 8) for row in group(i, 10, primary_diagnosis=f"d{i}")],
            *group(2, 5, primary_diagnosis="?"),
        )
    )
    row = findings.top_diagnosis_share(frame).first()
    assert (row["top_readmissions"], row["total_readmissions"]) == (3 + 4 + 5 + 6 + 7, 30)


def test_unknown_diagnosis_never_leads(spark):
    frame = normalize(
        make_raw(
            spark,
            *group(1, 5, primary_diagnosis="d1"),
            *group(4, 5, primary_diagnosis="?"),
        )
    )
    row = findings.top_diagnosis_share(frame).first()
    assert (row["top_readmissions"], row["total_readmissions"]) == (1, 5)


def test_disposition_ratio(spark):
    frame = make_encounters(
        spark,
        *group(4, 10, discharge_disposition="Home"),
        *group(2, 10, discharge_disposition="Home care"),
        *group(10, 10, discharge_disposition="Other"),
    ).selectExpr("*", "int(readmitted = '<30') AS readmitted_30d")
    assert findings.disposition_ratio(frame, "Home", "Home care").first()["rate_ratio"] == 2.0


def test_leading_age_bands_keep_ties(spark):
    frame = normalize(
        make_raw(
            spark,
            *group(5, 10, age_group="[70-80)"),
            *group(4, 10, age_group="[80-90)"),
            *group(4, 10, age_group="[60-70)"),
            *group(1, 10, age_group="[0-10)"),
        )
    )
    rows = rows_by(findings.leading_age_bands(frame), "age_group")
    assert {name: row["risk_rank"] for name, row in rows.items()} == {
        "[70-80)": 1,
        "[80-90)": 2,
        "[60-70)": 2,
    }


def test_correlation_far_from_zero(spark):
    frame = spark.range(1000).selectExpr("1e9 + id % 7 AS a", "1e9 + 2 * (id % 7) AS b", "1e9 AS c", "id % 5 AS d")
    found = {(r["x"], r["y"]): r["corr"] for r in cohorts.correlation_pairs(frame, ("a", "b", "c", "d")).collect()}
    assert found["b", "a"] == pytest.approx(frame.select(F.corr("a", "b")).first()[0])
    assert found["d", "a"] == pytest.approx(frame.select(F.corr("a", "d")).first()[0])
    assert found["c", "a"] is None and found["d", "c"] is None
