"""Physical plans: what is shuffled, read and where it runs."""

import re

import pytest
from pyspark.sql import functions as F

from oracle.compare import differences, open_tables
from oracle.statements import oracle_statements
from wardlight.operators import benchmarks, cohorts, descriptive, guarantee, one_row, quality
from wardlight.operators.normalize import drop_incomplete
from wardlight.plans import pipeline
from wardlight.plans.order_encounters import build_encounters, encounters, table
from wardlight.plans.registry import clean, normalized, registered_queries

DRIVER_TABLES = {"lr_coefficients", "risk_drivers"}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _details(frame):
    modes = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return frame._jdf.queryExecution().explainString(modes.fromString("formatted"))


def _indent(line):
    return len(line) - len(line.lstrip(" :+-"))


@pytest.mark.parametrize("name", sorted(set(registered_queries()) - DRIVER_TABLES))
def test_no_python_workers_and_no_cross_join(spark, small, name):
    plan = _plan(registered_queries()[name](spark, small))
    assert not re.search(r"Python|ArrowEval|MapInPandas|MapInArrow", plan)
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(set(registered_queries()) - DRIVER_TABLES))
def test_single_partitions_only_hold_aggregates(spark, small, name):
    """Below each exchange into one partition lies an aggregate, not a bare scan."""
    lines = _plan(registered_queries()[name](spark, small)).splitlines()
    for place, line in enumerate(lines):
        if "Exchange SinglePartition" in line or "TakeOrderedAndProject" in line:
            below = []
            for later in lines[place + 1 :]:
                if _indent(later) <= _indent(line):
                    break
                below.append(later)
            assert any("HashAggregate" in later for later in below), line


def test_monthly_report_reads_its_columns_only(spark, small):
    plan = _details(guarantee.monthly_scorecard(encounters(spark, small)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {entry.split(":")[0] for entry in schema.split(",")} == {
        "patient_id",
        "admission_date",
        "time_in_hospital",
        "num_medications",
        "readmitted",
    }


def test_critical_columns_are_filtered_in_the_scan(spark, small, tmp_path):
    # The extract run stores the normalized frame; the registry makes it as it reads.
    normalized(spark, small).write.parquet(str(tmp_path / "normalized"))
    stored = drop_incomplete(spark.read.parquet(str(tmp_path / "normalized")))
    plan = _details(descriptive.medication_curve(stored))
    assert "IsNotNull(age_numeric)" in plan and "IsNotNull(time_in_hospital)" in plan


def test_correlations_run_in_generated_code(spark, small):
    pairs = cohorts.correlation_pairs(clean(spark, small))
    pairs.collect()
    final = _plan(pairs).split("== Initial Plan ==")[0]
    partial = [line for line in final.splitlines() if "functions=[partial_count" in line]
    assert partial and all(re.search(r"\*\(\d+\) HashAggregate", line) for line in partial)


def test_scorecard_ships_one_column_of_the_encounters(spark, small):
    plan = _plan(quality.scorecard(encounters(spark, small)))
    assert "hashpartitioning(encounter_id" in plan
    assert plan.count("hashpartitioning") == 1


def test_diagnosis_share_reads_the_encounters_once(spark, small):
    share = registered_queries()["top5_diagnosis_share"](spark, small)
    share.collect()
    final = _plan(share).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


@pytest.fixture(scope="module")
def hot_tables(spark, small, tmp_path_factory):
    """The small tables with a third of the orders on one customer, day and part."""
    folder = tmp_path_factory.mktemp("hot")
    hot = F.col("o_orderkey") % 3 == 0
    table(spark, small, "orders").withColumn(
        "o_custkey", F.when(hot, 7).otherwise(F.col("o_custkey"))
    ).withColumn(
        "o_orderdate",
        F.when(hot & (F.col("o_orderkey") % 2 == 0), F.expr("timestamp_ntz'1998-05-05'")).otherwise(
            F.col("o_orderdate")
        ),
    ).repartition(8).write.parquet(str(folder / "orders.parquet"))
    table(spark, small, "lineitem").withColumn(
        "l_partkey", F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_partkey"))
    ).repartition(8).write.parquet(str(folder / "lineitem.parquet"))
    for name in ("customer", "part", "nation", "region"):
        table(spark, small, name).write.parquet(str(folder / f"{name}.parquet"))
    return folder


def _open(folder):
    connection = open_tables("/nonexistent")
    for path in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    return connection


def test_hot_customer_gives_the_same_reports(spark, hot_tables):
    connection = _open(hot_tables)
    for name in ("monthly_scorecard", "age_cohort_rank", "kpi_summary", "diagnosis_risk_top20"):
        result = registered_queries()[name](spark, str(hot_tables))
        assert differences(result, connection, oracle_statements()[name]) == [], name


def test_hot_partitions_are_split_when_nothing_fits_a_broadcast(spark, hot_tables):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        built = build_encounters(spark, str(hot_tables))
        rows = built.collect()
        final = _plan(built)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "isFinalPlan=true" in final
    assert "SortMergeJoin(skew=true)" in final
    # The only sequence runs over a customer's days; orders are never grouped by
    # customer alone.
    windows = [line for line in final.splitlines() if "Window [lead" in line]
    assert windows and all("o_orderdate" in line for line in windows)
    assert len(rows) == encounters(spark, str(hot_tables)).count()


def test_lookup_joins_are_left_to_the_size_of_the_dimension(spark, small):
    dispositions = table(spark, small, "nation").select(
        F.col("n_nationkey").alias("disposition_id")
    )
    report = benchmarks.disposition_impact(encounters(spark, small), dispositions)
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_reports_are_one_scan(spark, small):
    table_of = encounters(spark, small)
    quarter = "Q2 1996"
    parts = pipeline.one_row_parts(quarter, pipeline.admitted_in(quarter), ("O", "F"))
    frame = pipeline.with_outcomes(table_of)
    measured = one_row.all_measures(frame, parts)
    measured.collect()
    final = _plan(measured).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "Expand" not in final
    reports = one_row.together(frame, parts)
    assert all("FileScan" not in _plan(report) for report in reports.values())
    expected = {
        **pipeline.finding_reports(table_of, quarter, ("O", "F")),
        "dq_null_counts": quality.null_counts(table_of),
        "kpi_summary": descriptive.kpi_summary(table_of),
    }
    assert len(reports) == 5
    for name, report in reports.items():
        assert report.columns == expected[name].columns
        assert report.first() == pytest.approx(expected[name].first()), name
