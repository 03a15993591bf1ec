import datetime

import pytest
from pyspark.sql import functions as F

from oracle.compare import differences, open_tables
from oracle.statements import oracle_statements
from tests.helpers import make_encounters
from wardlight.operators.model import RiskModel
from wardlight.plans import pipeline
from wardlight.plans.order_encounters import encounters, raw_encounters, table
from wardlight.sources.encounters import read_encounters, write_encounters

PERIOD = "all admissions"


@pytest.fixture(scope="module")
def extract_run(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("extract")
    raw_encounters(spark, small).write.csv(str(folder / "csv"), header=True, nullValue="?")
    fitted = pipeline.run_extract(
        spark, str(folder / "csv"), str(folder / "out"), PERIOD, token_secret="fixture"
    )
    return folder / "out", fitted


@pytest.mark.parametrize(
    "name",
    [
        "dq_null_profile",
        "norm_drop_critical",
        "kpi_long",
        "readmission_distribution",
        "los_box_stats",
        "age_rate_panel",
        "medication_curve",
        "period_guarantee",
        "polypharmacy_ratio",
        "top5_diagnosis_share",
        "leading_age_bands",
        "risk_scores",
        "patient_risk",
        "model_metrics",
        "classification_report",
    ],
)
def test_extract_reports_match_their_sql(spark, small, extract_run, name):
    out, _ = extract_run
    stored = spark.read.parquet(str(out / name))
    assert differences(stored, open_tables(small), oracle_statements()[name]) == []


def test_extract_run_stores_the_model(spark, extract_run):
    out, fitted = extract_run
    assert RiskModel.load(spark, str(out / "risk_model")) == fitted
    assert spark.read.parquet(str(out / "risk_drivers")).count() == 6


def _lookups(spark, folder):
    nation = table(spark, folder, "nation")
    return (
        nation.select(F.col("n_nationkey").alias("disposition_id")),
        table(spark, folder, "region").select(F.col("r_regionkey").alias("specialty_id")),
        nation.select(F.col("n_nationkey").alias("source_id")),
    )


def test_warehouse_run(spark, small, tmp_path):
    names = pipeline.run_warehouse(
        encounters(spark, small), *_lookups(spark, small), str(tmp_path)
    )
    assert len(names) == 18
    assert all((tmp_path / name / "_SUCCESS").exists() for name in names)
    stored = spark.read.parquet(str(tmp_path / "monthly_scorecard")).drop("month")
    statement = oracle_statements()["monthly_scorecard"]
    assert differences(stored, open_tables(small), statement) == []


def test_warehouse_run_of_a_quarter_on_the_stored_table(spark, small, tmp_path):
    write_encounters(encounters(spark, small), str(tmp_path / "table"))
    stored = read_encounters(spark, str(tmp_path / "table"))
    names = pipeline.run_warehouse(
        stored, *_lookups(spark, small), str(tmp_path / "out"), period="Q2 1996", compared_dispositions=("O", "F")
    )
    assert "disposition_ratio" in names
    report = spark.read.parquet(str(tmp_path / "out" / "period_guarantee"))
    assert differences(report, open_tables(small), oracle_statements()["quarter_guarantee"]) == []


def test_extract_of_a_quarter(spark, small, tmp_path):
    dated = raw_encounters(spark, small).withColumn(
        "admission_date", F.when(F.col("encounter_id") % 2 == 0, "2024-11-05 08:00:00").otherwise("2024-01-05")
    )
    dated.write.csv(str(tmp_path / "csv"), header=True, nullValue="?")
    pipeline.run_extract(spark, str(tmp_path / "csv"), str(tmp_path / "out"), "Q4 2024", token_secret="fixture")
    even = dated.where("encounter_id % 2 = 0").count()
    kpis = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "out" / "kpi_long")).collect()}
    assert 0 < int(float(str(kpis["Total Encounters"]).replace(",", ""))) <= even
    assert spark.read.parquet(str(tmp_path / "out" / "normalized")).count() == dated.count()


def test_a_quarter_needs_dates(spark, small, tmp_path):
    raw_encounters(spark, small).write.csv(str(tmp_path / "csv"), header=True, nullValue="?")
    with pytest.raises(ValueError, match="no admission_date"):
        pipeline.run_extract(spark, str(tmp_path / "csv"), str(tmp_path / "out"), "Q4 2024", token_secret="x")
    assert not (tmp_path / "out").exists()


def test_failed_checks_stop_the_reports(spark, small, tmp_path):
    frame = make_encounters(spark, {"encounter_id": 5, "times": 2}, {"patient_id": None})
    with pytest.raises(pipeline.QualityCheckFailed, match="duplicate_encounters"):
        pipeline.run_warehouse(frame, *_lookups(spark, small), str(tmp_path))
    assert [path.name for path in tmp_path.iterdir()] == ["dq_scorecard"]


@pytest.mark.parametrize(
    "period, first, after",
    [
        ("Q1 2020", (2020, 1, 1), (2020, 4, 1)),
        ("Q4 2024", (2024, 10, 1), (2025, 1, 1)),
    ],
)
def test_quarter_bounds(period, first, after):
    assert pipeline.quarter_bounds(period) == (datetime.date(*first), datetime.date(*after))


def test_unknown_period():
    with pytest.raises(ValueError, match="not a quarter"):
        pipeline.quarter_bounds("2024")


def test_encounters_of_a_quarter(spark):
    days = [(2020, 3, 31), (2020, 4, 1), (2020, 6, 30), (2020, 7, 1)]
    frame = make_encounters(
        spark, *[{"admission_date": datetime.datetime(*day, 12)} for day in days]
    )
    kept = pipeline.in_quarter(frame, "Q2 2020").collect()
    assert sorted(row["encounter_id"] for row in kept) == [2, 3]


def test_a_stopped_extract_run_goes_on(spark, small, tmp_path, monkeypatch, extract_run):
    """Stopped after the fit: no second fit, nothing stored is written again, the same rows."""
    out, fitted = extract_run
    source, again = str(out.parent / "csv"), tmp_path / "out"
    arguments = (spark, source, str(again), PERIOD, "fixture")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(pipeline.model, "patient_risk", stop)
        with pytest.raises(KeyboardInterrupt):
            pipeline.run_extract(*arguments)
    stored = {file: file.stat().st_mtime_ns for file in again.rglob("part-*")}
    assert (again / "risk_model").is_dir() and not (again / "model_metrics").exists()
    with monkeypatch.context() as patched:
        patched.setattr(pipeline.model, "fit_risk_model", stop)
        patched.setattr(pipeline, "read_raw_csv", stop)
        assert pipeline.run_extract(*arguments) == fitted
    assert {file: file.stat().st_mtime_ns for file in stored} == stored
    for name in ("patient_risk", "model_metrics", "classification_report"):
        rows = spark.read.parquet(str(again / name)).collect()
        assert sorted(rows, key=str) == sorted(spark.read.parquet(str(out / name)).collect(), key=str)
    # Another period is another run.
    other = pipeline.RunManifest(spark, str(again), "something else")
    assert not other.done("normalized")


def test_extract_run_counts_broken_rows(spark, small, tmp_path):
    raw_encounters(spark, small).coalesce(1).write.csv(str(tmp_path / "csv"), header=True, nullValue="?")
    (tmp_path / "csv" / "more.csv").write_text("age,encounter_id\n[0-10),5,6\n")
    with pytest.raises(ValueError, match="admission_date"):
        pipeline.run_extract(spark, str(tmp_path / "csv"), str(tmp_path / "out"), "Q1 1996", "fixture")
    assert not (tmp_path / "out" / "normalized").exists()
    pipeline.run_extract(spark, str(tmp_path / "csv"), str(tmp_path / "out"), PERIOD, "fixture")
    n = raw_encounters(spark, small).count()
    broken = spark.read.parquet(str(tmp_path / "out" / "dq_broken_rows")).first()
    assert broken.asDict() == {"rows_read": n + 1, "rows_broken": 1, "rows_empty": 0}
    assert spark.read.parquet(str(tmp_path / "out" / "normalized")).count() == n
