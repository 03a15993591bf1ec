import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import make_encounters, make_raw
from wardlight.operators import quality
from wardlight.operators.normalize import normalize
from wardlight.plans import pipeline
from wardlight.plans.order_encounters import build_encounters, raw_encounters
from wardlight.schema import ENCOUNTER_SCHEMA, canonicalize, unreadable_mask, unreadable_values
from wardlight.session import report_options
from wardlight.sources import shared
from wardlight.sources.encounters import (
    BROKEN_ROW,
    broken_rows,
    file_layouts,
    read_encounters,
    read_raw_csv,
    whole_rows,
    write_encounters,
)
from wardlight.sources.sinks import save_table, write_report


def test_csv_gives_the_same_encounters(spark, small, tmp_path):
    raw = raw_encounters(spark, small)
    path = str(tmp_path / "extract")
    # Columns in another order, one of them unused, NULLs as the missing marker.
    shuffled = raw.select(*reversed(raw.columns)).withColumn("weight", F.lit("?"))
    shuffled.write.csv(path, header=True, nullValue="?")
    read = normalize(whole_rows(read_raw_csv(spark, path)))
    expected = normalize(raw)
    assert read.dtypes == expected.dtypes
    assert read.exceptAll(expected).count() == 0 and expected.exceptAll(read).count() == 0


def test_files_with_other_column_orders(spark, tmp_path):
    path = tmp_path / "extract"
    path.mkdir()
    table = make_raw(spark, {"time_in_hospital": 7, "num_medications": 3}).toPandas().astype(str)
    table.to_csv(path / "a.csv", index=False)
    table[list(reversed(table.columns))].to_csv(path / "b.csv", index=False)
    rows = normalize(read_raw_csv(spark, str(path))).collect()
    assert [(r["time_in_hospital"], r["num_medications"]) for r in rows] == [(7, 3)] * 2


def test_numbers_written_with_a_fraction_and_unreadable_ones(spark):
    raw = make_raw(spark, {"times": 5}).withColumn(
        "time_in_hospital",
        F.element_at(F.array(*map(F.lit, ("7.0", "3 days", "?", "2.5", "8"))), F.col("encounter_id").cast("int")),
    )
    frame = canonicalize(raw, unreadable_mask(raw).alias("unreadable"))
    assert [r["time_in_hospital"] for r in frame.orderBy("encounter_id").collect()] == [7, None, None, None, 8]
    found = {r["column_name"]: (r["given_values"], r["unreadable_values"]) for r in unreadable_values(frame).collect()}
    assert found["time_in_hospital"] == (4, 2) and found["num_medications"] == (5, 0)


def test_reading_a_stored_table_leaves_the_schema_alone(spark, small, tmp_path):
    fields = list(ENCOUNTER_SCHEMA.fields)
    write_encounters(make_encounters(spark, {}), str(tmp_path / "table"))
    for _ in range(2):
        assert read_encounters(spark, str(tmp_path / "table")).count() == 1
        assert build_encounters(spark, small).columns == [field.name for field in fields]
    assert ENCOUNTER_SCHEMA.fields == fields


def test_rewritten_input_is_derived_again(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    for n in (1, 2):
        spark.range(n).write.mode("overwrite").parquet(f"{source}/t.parquet")
        (tmp_path / "in" / f"marker{n}").write_text("x" * n)
        table = shared.shared_table(spark, "probe", source, lambda: spark.read.parquet(f"{source}/t.parquet"))
        assert table.count() == n


def test_text_none_is_not_missing(spark, tmp_path):
    path = str(tmp_path / "extract")
    make_raw(spark, {"a1c_result": "None"}).write.csv(path, header=True)
    row = normalize(read_raw_csv(spark, path)).first()
    assert row["a1c_result"] == "None" and row["has_a1c_result"] == 0


def test_stored_encounters_prune_by_month(spark, tmp_path):
    frame = make_encounters(
        spark,
        {"admission_date": datetime.datetime(2020, 1, 31)},
        {"admission_date": datetime.datetime(2020, 2, 1), "times": 3},
        {"admission_date": None},
    )
    path = str(tmp_path / "encounters")
    write_encounters(frame, path)
    stored = read_encounters(spark, path)
    assert stored.drop("admission_month").exceptAll(frame).count() == 0
    february = stored.where(F.col("admission_month") == datetime.date(2020, 2, 1))
    assert february.count() == 3
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(admission_month" in plan


def test_report_formats(spark, tmp_path):
    report = spark.createDataFrame([("a", 1.5)], "name string, value double")
    write_report(report, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["name", "value"]
    write_report(report, str(tmp_path / "parts"), partition_by=("name",))
    assert (tmp_path / "parts" / "name=a").is_dir()
    with pytest.raises(ValueError, match="format"):
        write_report(report, str(tmp_path / "x"), "xml")


def test_shared_table_is_built_once_and_again_when_gone(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    source = str(tmp_path)
    for _ in range(2):
        assert shared.shared_table(spark, "numbers", source, build).count() == 5
    assert len(built) == 1
    key = next(key for key in shared._written if key[3].startswith(source))
    shared._written[key] = (str(tmp_path / "gone"), shared._written[key][1])
    assert shared.shared_table(spark, "numbers", source, build).count() == 5
    assert len(built) == 2


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class _Settings(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _ClusterSession:
    conf = _Settings({"spark.master": "yarn"})


def test_no_machine_local_folder_on_a_cluster():
    assert shared.shared_folder(_ClusterSession()) is None
    assert shared.shared_table(_ClusterSession(), "t", "s", lambda: "plan") == "plan"


def test_partitions_follow_the_input():
    laptop = report_options(0, 8)
    assert laptop["spark.sql.shuffle.partitions"] == "8"
    assert laptop["spark.sql.files.maxPartitionBytes"] == str(128 * 1024**2)
    cluster = report_options(100 * 10**12, 8000)
    assert 30_000 < int(cluster["spark.sql.shuffle.partitions"]) < 50_000
    assert 100_000 < 100 * 10**12 / int(cluster["spark.sql.files.maxPartitionBytes"]) < 150_000


def _write_files(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_extract_of_any_files(spark, tmp_path):
    """Column orders, broken rows, line ends in quotes, doubled quotes, blank and empty files, folders, odd names."""
    path = _write_files(
        tmp_path / "x",
        a='encounter_id,y,z\n1,2,3\n1,2\n"4\n5",6,"say ""hi"""\n1,2,3,4\n,,\n',
        b="\n\nz,y,encounter_id\n30,20,10\n",
        empty="",
    )
    _write_files(tmp_path / "x" / "more", **{"c d": "﻿encounter_id,y,z\n7,8,?\n"})
    raw = read_raw_csv(spark, path)
    rows = {tuple(row) for row in whole_rows(raw).select("encounter_id", "y", "z").collect()}
    assert rows == {
        ("1", "2", "3"), ("4\n5", "6", 'say "hi"'), (None, None, None), ("10", "20", "30"), ("7", "8", None),
    }
    assert whole_rows(raw).count() == 5 and whole_rows(raw).select("y").count() == 5
    assert broken_rows(raw).first().asDict() == {"rows_read": 7, "rows_broken": 2, "rows_empty": 1}
    assert {row[BROKEN_ROW] for row in raw.select("y", BROKEN_ROW).collect()} == {None, "1,2", "1,2,3,4"}


def test_only_files_with_line_ends_in_quotes_stay_whole(spark, tmp_path):
    path = _write_files(tmp_path / "x", a="encounter_id,y\n1,2\n", b='encounter_id,y\n1,"2\n3"\n')
    found = {row["file"].rpartition("/")[2]: row["multi_line"] for row in file_layouts(spark, path).collect()}
    assert found == {"a.csv": False, "b.csv": True}


def test_extract_without_a_header(spark, tmp_path):
    with pytest.raises(ValueError, match="no header .* in .*b.csv"):
        read_raw_csv(spark, _write_files(tmp_path / "x", a="encounter_id,y\n1,2\n", b="1,2\n"))
    with pytest.raises(ValueError, match="twice: y"):
        read_raw_csv(spark, _write_files(tmp_path / "y", a="encounter_id,y,y\n1,2,3\n"))
    with pytest.raises(ValueError, match="no CSV file"):
        read_raw_csv(spark, _write_files(tmp_path / "z", a=""))


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 12):
        path = _write_files(tmp_path / f"n{n}", **{f"f{i}": "encounter_id,y\n1,2\n" for i in range(n)})
        spark.sparkContext.setJobGroup(f"layouts{n}", "")
        read_raw_csv(spark, path)
        jobs.append(len(tracker.getJobIdsForGroup(f"layouts{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 3


def _files(folder):
    return {file: file.stat().st_mtime_ns for file in folder.rglob("part-*")}


def test_replacing_a_month_leaves_the_others_alone(spark, tmp_path):
    def report(*rows):
        return spark.createDataFrame(rows, "month string, value int")

    path, target = str(tmp_path / "r"), tmp_path / "r"
    options = {"partition_by": ("month",), "keep_other_partitions": True}
    write_report(report(("2020-01", 1), ("2020-02", 2)), path, **options)
    before = _files(target / "month=2020-01")
    for _ in range(2):
        write_report(report(("2020-02", 3), ("2020-03", 4)), path, **options)
    assert _files(target / "month=2020-01") == before
    rows = {tuple(row) for row in spark.read.parquet(path).select("month", "value").collect()}
    assert rows == {("2020-01", 1), ("2020-02", 3), ("2020-03", 4)}
    with pytest.raises(ValueError, match="partitioned"):
        write_report(report(("2020-01", 1)), path, keep_other_partitions=True)


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    scores = make_encounters(spark, {"patient_id": 1, "times": 3}, {"patient_id": 2})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("visits", "patients"):
            part = scores if name == "visits" else scores.select("patient_id", "gender").distinct()
            save_table(part, name, str(tmp_path / name), "patient_id", 4)
        joined = spark.table("visits").join(spark.table("patients"), "patient_id").groupBy("patient_id").count()
        assert {tuple(row) for row in joined.collect()} == {(1, 3), (2, 1)}
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        details = {row["col_name"]: row["data_type"] for row in spark.sql("DESCRIBE EXTENDED visits").collect()}
        assert "4 rows" in details["Statistics"]
        described = spark.sql("DESCRIBE EXTENDED visits patient_id").collect()
        assert {row["info_name"]: row["info_value"] for row in described}["distinct_count"] == "2"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("visits", "patients"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stored_counts_give_the_scorecard(spark, tmp_path):
    frame = make_encounters(spark, {"times": 30}, {"age": 200}, {"patient_id": None}, {"readmitted": None, "times": 9})
    frame = frame.unionByName(frame.where("encounter_id < 4"))
    path = str(tmp_path / "encounters")
    pipeline.store_encounters(frame, path)
    tolerances = {"max_null_pct": 2.0, "max_null_pct_by_column": {"readmitted": 50.0}, "max_failed_pct": 3.0}
    stored = pipeline.stored_scorecard(spark, path, **tolerances)
    assert sorted(stored.collect()) == sorted(quality.scorecard(frame, **tolerances).collect())
    read = set(stored.inputFiles())
    assert read and all("encounters_checks" in file for file in read)
    assert "Exchange hashpartitioning" not in stored._jdf.queryExecution().executedPlan().toString()
