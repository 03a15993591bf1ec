"""Writing report tables, as files and in the catalog."""

from pyspark.sql import DataFrame, Observation, SparkSession

FORMATS = ("parquet", "csv")


def write_report(
    report: DataFrame,
    path: str,
    file_format: str = "parquet",
    partition_by: tuple = (),
    keep_other_partitions: bool = False,
) -> None:
    """Store one report; CSV carries a header for BI tools.

    Reports are aggregates, so the number of files follows from adaptive
    coalescing and nothing is forced through one task. With `keep_other_partitions` only
    the partitions the report has rows of are replaced, so writing a month again leaves the
    files of the others alone and has the same result as writing it once.
    """
    if file_format not in FORMATS:
        raise ValueError(f"unknown report format {file_format!r}, expected one of {FORMATS}")
    if keep_other_partitions and not partition_by:
        raise ValueError("only a partitioned report can be replaced in part")
    writer = report.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic" if keep_other_partitions else "static").save(path)


def save_table(report: DataFrame, name: str, path: str, bucket_by: str, buckets: int) -> None:
    """Store a report as a catalog table with statistics, dealt into buckets by a column.

    Tables of equally many buckets by the same column are joined and grouped by it
    without a shuffle, and the statistics of all columns guide the plans of dashboards.
    Every bucket is written by one task, so a column with hot values needs more buckets.
    """
    (
        report.repartition(buckets, bucket_by)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", path)
        .bucketBy(buckets, bucket_by)
        .sortBy(bucket_by)
        .saveAsTable(name)
    )
    report.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def observed_row(spark: SparkSession, seen: Observation) -> DataFrame:
    """The metrics observed during a write, as a table of one row."""
    found = seen.get
    fields = ", ".join(f"`{name}` bigint" for name in found)
    return spark.createDataFrame([tuple(found.values())], fields)
