"""Reading encounters: raw CSV extracts and stored tables."""

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.fixed_values import MISSING_MARKER
from wardlight.schema import ENCOUNTER_SCHEMA

#: The text of a row whose number of fields does not fit its file's header; NULL for all others.
BROKEN_ROW = "_broken_row"

#: The column by whose name a header line is known; every extract has it.
KEY_COLUMN = "encounter_id"


def file_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, header line, whether quoted fields hold line ends) of every CSV file with a header.

    One scan of the lines finds both: of a file's first block, lines that name the key column, and of
    all blocks, lines in which a quote stays open. Few lines are either, and only they are grouped.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    named = (F.col("_metadata.file_block_start") == 0) & F.contains("value", F.lit(KEY_COLUMN))
    marked = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.when(named, F.col("value")).alias("header"),
        # The lines of a file's block are read in order, by one task.
        F.monotonically_increasing_id().alias("line"),
        (quotes % 2 == 1).alias("open"),
    ).where(F.col("open") | F.col("header").isNotNull())
    first = F.min(F.when(F.col("header").isNotNull(), F.struct("line", "header")))
    found = marked.groupBy("file").agg(first["header"].alias("header"), F.max("open").alias("multi_line"))
    return found.where("header IS NOT NULL")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A raw extract with a header row per file; the missing marker reads as NULL.

    Columns are taken by name and typed during normalization, so there is no
    inference pass over the data. Spark binds CSV columns by position, so files are read
    together only if their headers agree; files with other column orders are read apart
    and united by name. Files in which quoted fields hold line ends cannot be split and are
    read by one task each; all others are split. One job finds out, however many files
    there are. Quotes inside quoted fields are doubled; folders below the path belong to the extract.

    A row with too few or too many fields keeps what could be read, and its text stands in
    `_broken_row`; see `whole_rows` and `broken_rows`.
    """
    layouts = file_layouts(spark, path).groupBy("header", "multi_line").agg(F.collect_list("file").alias("files"))
    layouts = sorted(layouts.collect())
    headed = {file for layout in layouts for file in layout["files"]}
    headless = _without(spark, path, headed)
    if headless:
        raise ValueError(f"no header with {KEY_COLUMN!r} in {', '.join(headless)}")
    parts = []
    for line, multi_line, files in layouts:
        names = next(csv.reader([line.removeprefix("\ufeff")]))
        repeated = sorted({name for name in names if names.count(name) > 1})
        if repeated:
            raise ValueError(f"a header names columns twice: {', '.join(repeated)}")
        reader = spark.read.schema(
            T.StructType([T.StructField(name, T.StringType()) for name in (*names, BROKEN_ROW)])
        ).options(
            header=True,
            nullValue=MISSING_MARKER,
            escape='"',
            multiLine=multi_line,
            mode="PERMISSIVE",
            # A reader that skips the columns a query does not use cannot count a row's fields.
            columnPruning=False,
            columnNameOfCorruptRecord=BROKEN_ROW,
        )
        if len(layouts) == 1:
            parts.append(reader.option("recursiveFileLookup", True).csv(path))
        else:
            parts.append(reader.csv(sorted(map(unquote, files))))
    if not parts:
        raise ValueError(f"no CSV file with a header in {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _without(spark: SparkSession, path: str, headed: set[str]) -> list[str]:
    """Up to ten files with lines that are not among those with a header."""
    listed = spark.read.option("recursiveFileLookup", True).text(path).inputFiles()
    others = {file.replace(":///", ":/") for file in listed} - {file.replace(":///", ":/") for file in headed}
    if not others:
        return []
    lines = spark.read.text(sorted(map(unquote, others))).where(F.trim("value") != "")
    return [row["file"] for row in lines.select(F.col("_metadata.file_path").alias("file")).distinct().limit(10).collect()]


def whole_rows(raw: DataFrame) -> DataFrame:
    """The rows of an extract whose fields fit their header."""
    fields = [F.col(f"`{name}`") for name in raw.columns if name != BROKEN_ROW]
    # Always true. Spark refuses to look at the mark alone, as a mere count of the rows would.
    read = F.hash(*fields) >= F.lit(-(1 << 31))
    return raw.where(F.col(BROKEN_ROW).isNull() & read).drop(BROKEN_ROW)


def broken_row_counts(raw: DataFrame) -> list[Column]:
    """Aggregates: rows read, those whose fields do not fit their header, and others without any value."""
    fields = [F.col(f"`{name}`") for name in raw.columns if name != BROKEN_ROW]
    broken = F.col(BROKEN_ROW).isNotNull()
    return [
        F.count("*").alias("rows_read"),
        F.count_if(broken).alias("rows_broken"),
        F.count_if(~broken & F.coalesce(*fields).isNull()).alias("rows_empty"),
    ]


def broken_rows(raw: DataFrame) -> DataFrame:
    """One row of `broken_row_counts`."""
    return raw.agg(*broken_row_counts(raw))


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    """The stored fact table; filters on `admission_month` prune its folders."""
    month = T.StructField("admission_month", T.DateType())
    return spark.read.schema(T.StructType([*ENCOUNTER_SCHEMA.fields, month])).parquet(path)


def write_encounters(encounters: DataFrame, path: str) -> None:
    """Store the fact table, one folder per admission month.

    The rebalance hint spreads a month over as many tasks as its size needs, so
    neither one huge month nor many small files result.
    """
    (
        encounters.withColumn("admission_month", F.trunc("admission_date", "month"))
        .hint("rebalance", "admission_month")
        .write.mode("overwrite")
        .partitionBy("admission_month")
        .parquet(path)
    )
