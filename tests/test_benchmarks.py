from tests.helpers import group, make_encounters, rows_by
from wardlight.operators import benchmarks


def _lookup(spark, key, *values):
    return spark.createDataFrame([(value,) for value in values], f"{key} int")


def test_running_total_from_worst_to_best(spark):
    frame = make_encounters(
        spark,
        *group(1, 10, discharge_disposition="b"),
        *group(5, 10, discharge_disposition="a"),
        *group(1, 10, discharge_disposition="c"),
    )
    rows = benchmarks.disposition_impact(frame, _lookup(spark, "disposition_id", 1)).collect()
    assert [(row["discharge_disposition"], row["cumulative_discharges"]) for row in rows] == [
        ("a", 10),
        ("b", 20),
        ("c", 30),
    ]


def test_repeated_lookup_keys_do_not_multiply_encounters(spark):
    frame = make_encounters(spark, *group(2, 60))
    dispositions = _lookup(spark, "disposition_id", 1, 1, None)
    total = benchmarks.disposition_impact(frame, dispositions).first()["total_discharges"]
    assert total == 60
    row = benchmarks.specialty_source_benchmark(
        frame, _lookup(spark, "specialty_id", 1, 1), _lookup(spark, "source_id", 1, 1, 1)
    ).first()
    assert row["encounters"] == 60


def test_lookup_without_match_keeps_encounters(spark):
    keys = (99, None)
    frame = make_encounters(spark, *[{"discharge_disposition_id": key} for key in keys])
    row = benchmarks.disposition_impact(frame, _lookup(spark, "disposition_id", 1)).first()
    assert row["total_discharges"] == 2


def test_benchmark_is_unweighted_over_reported_groups(spark):
    frame = make_encounters(
        spark,
        *group(10, 50, medical_specialty="a"),
        *group(0, 150, medical_specialty="b"),
        *group(49, 49, medical_specialty="small"),
        *group(50, 50, medical_specialty=None),
    )
    rows = rows_by(
        benchmarks.specialty_source_benchmark(
            frame, _lookup(spark, "specialty_id", 1), _lookup(spark, "source_id", 1)
        ),
        "medical_specialty",
    )
    assert set(rows) == {"a", "b"}
    assert {row["overall_avg_rate"] for row in rows.values()} == {10.0}
    assert rows["a"]["variance_from_benchmark"] == 10.0
    assert rows["b"]["variance_from_benchmark"] == -10.0


def test_unused_lookups_are_optimized_away(spark):
    frame = make_encounters(spark, {})
    report = benchmarks.specialty_source_benchmark(
        frame, _lookup(spark, "specialty_id", 1), _lookup(spark, "source_id", 1)
    )
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()
