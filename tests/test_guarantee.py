import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import group, make_encounters, make_raw
from wardlight.fixed_values import MONTH_STATUS, PERIOD_STATUS
from wardlight.operators import guarantee
from wardlight.operators.normalize import normalize
from wardlight.plans import pipeline


def _month(year, month):
    return {"admission_date": datetime.datetime(year, month, 10)}


def test_status_at_exact_limits(spark):
    frame = make_encounters(
        spark,
        *group(11, 100, **_month(2020, 1)),
        *group(13, 100, **_month(2020, 2)),
        *group(131, 1000, **_month(2020, 3)),
    )
    rows = guarantee.monthly_scorecard(frame).collect()
    assert [row["performance_status"] for row in rows] == list(MONTH_STATUS)
    assert [row["readmission_rate_pct"] for row in rows] == [11.0, 13.0, 13.1]
    assert [row["prev_month_rate"] for row in rows] == [None, 11.0, 13.0]
    assert [row["rate_change_mom"] for row in rows] == [None, 2.0, 0.1]
    assert [row["rolling_3mo_avg"] for row in rows] == [11.0, 12.0, 12.37]


def test_unknown_month_comes_last(spark):
    frame = make_encounters(
        spark, {"admission_date": None, "readmitted": "<30"}, *group(0, 4, **_month(2020, 1))
    )
    rows = guarantee.monthly_scorecard(frame).collect()
    assert [row["report_month"] for row in rows] == [datetime.datetime(2020, 1, 1), None]
    assert rows[1]["prev_month_rate"] == 0.0


def test_skipped_month_is_passed_over_unless_densified(spark):
    frame = make_encounters(
        spark, *group(1, 10, **_month(2019, 12)), *group(3, 10, **_month(2020, 2))
    )
    sparse = guarantee.monthly_scorecard(frame).collect()
    assert [row["rate_change_mom"] for row in sparse] == [None, 20.0]
    dense = guarantee.monthly_scorecard(frame, densify=True).collect()
    assert [row["total_admissions"] for row in dense] == [10, 0, 10]
    assert [row["readmission_rate_pct"] for row in dense] == [10.0, None, 30.0]
    assert [row["rate_change_mom"] for row in dense] == [None, None, None]
    assert dense[1]["performance_status"] is None
    assert dense[2]["rolling_3mo_avg"] == 20.0


def test_densified_keeps_unknown_months(spark):
    frame = make_encounters(spark, {"admission_date": None}, _month(2020, 1), _month(2020, 3))
    rows = guarantee.monthly_scorecard(frame, densify=True).collect()
    assert [row["total_admissions"] for row in rows] == [1, 0, 1, 1]
    assert rows[-1]["report_month"] is None


def test_distinct_patients_per_month(spark):
    frame = make_encounters(
        spark, {"patient_id": 1, "times": 3}, {"patient_id": 2}, {"patient_id": None}
    )
    assert guarantee.monthly_scorecard(frame).first()["unique_patients"] == 2


def test_nothing_to_report(spark):
    nothing = make_encounters(spark, {}).limit(0)
    assert guarantee.monthly_scorecard(nothing).count() == 0
    assert guarantee.monthly_scorecard(nothing, densify=True).count() == 0


@pytest.mark.parametrize("hits, status", [(11, PERIOD_STATUS[0]), (12, PERIOD_STATUS[1])])
def test_period_status(spark, hits, status):
    frame = normalize(make_raw(spark, *group(hits, 100)))
    row = guarantee.period_guarantee(frame, "Q1 2020").first()
    assert (row["period"], row["status"]) == ("Q1 2020", status)
    assert row["readmission_rate_30day_pct"] == float(hits)



def test_states_of_batches_make_the_same_scorecard(spark):
    """Patients in several batches and months, ids around the bitmaps' ends, unknown values and dates."""
    ids = [1, 32768, 32769, -5, 0, 10**12, None, 1, 1]
    rows = [
        {
            "patient_id": ids[i % len(ids)],
            "admission_date": None if i % 17 == 0 else datetime.datetime(2020, 1 + i % 5, 1 + i % 28),
            "time_in_hospital": None if i % 7 == 0 else i % 13,
            "num_medications": i % 31,
            "readmitted": ("<30", "NO", ">30", None)[i % 4],
        }
        for i in range(120)
    ]
    frame = make_encounters(spark, *rows)
    parts = [guarantee.month_states(frame.where(f"encounter_id % 3 = {k}")) for k in range(3)]
    states = guarantee.MonthStates(
        parts[0].totals.unionByName(parts[1].totals).unionByName(parts[2].totals),
        parts[0].patients.unionByName(parts[1].patients).unionByName(parts[2].patients),
    )
    for densify in (False, True):
        expected = guarantee.monthly_scorecard(frame, densify=densify).collect()
        assert guarantee.scorecard_of_states(states, densify=densify).collect() == expected
    # Two months together: their union, not their sum.
    two = frame.where("month(admission_date) IN (1, 2)")
    union = guarantee.month_states(two).patients.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("b"))
    assert union.agg(F.sum(F.bitmap_count("b"))).first()[0] == two.agg(F.countDistinct("patient_id")).first()[0]


def test_a_refresh_writes_the_touched_months_and_two_rows_after_each(spark, tmp_path):
    months = [(2020, m, 3) for m in range(1, 10)]
    first = make_encounters(spark, *[{"admission_date": datetime.datetime(*d), "times": 3} for d in months])
    more = make_encounters(spark, {"admission_date": datetime.datetime(2020, 3, 9), "readmitted": "<30", "patient_id": 8})
    states, report = str(tmp_path / "states"), tmp_path / "report"
    pipeline.refresh_scorecard(first, states, "a", str(report))
    before = {f.name: {p.name for p in f.glob("part-*")} for f in report.glob("month=*")}
    for _ in range(2):
        pipeline.refresh_scorecard(more, states, "b", str(report))
    after = {f.name: {p.name for p in f.glob("part-*")} for f in report.glob("month=*")}
    assert {name for name in after if after[name] != before[name]} == {f"month=2020-0{m}" for m in (3, 4, 5)}
    stored = spark.read.parquet(str(report)).drop("month")
    expected = guarantee.monthly_scorecard(first.unionByName(more))
    assert sorted(stored.collect()) == sorted(expected.collect())
