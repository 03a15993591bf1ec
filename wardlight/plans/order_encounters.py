"""Encounters derived from the order tables.

An order with at least one line plays an encounter: the customer is the patient,
the order date the admission, the lines are the diagnoses, and the customer's next
order decides the outcome.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    AGE_BANDS,
    MISSING_MARKER,
    NOT_READMITTED,
    READMITTED_AFTER_30,
    READMITTED_WITHIN_30,
)
from wardlight.schema import ENCOUNTER_SCHEMA
from wardlight.sources.shared import shared_files, shared_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def build_encounters(spark: SparkSession, folder: str) -> DataFrame:
    """The lazy plan of the fact table.

    No step groups whole orders by customer: a customer's order days come out of
    a map-side combined aggregate, number at most one per calendar day, and only
    they are put in sequence. Orders then meet their day by (customer, day), so
    even a customer with a third of all orders is spread over many tasks. The
    joins on large keys are left to Spark: it broadcasts the sides that turn out
    small and splits skewed partitions where none is.
    """
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").cast("int").alias("n_lines"),
            F.min("l_quantity").cast("int").alias("min_qty"),
            F.sum("l_quantity").cast("int").alias("sum_qty"),
            F.count_if(F.col("l_returnflag") == "R").cast("int").alias("n_ret"),
            F.min("l_partkey").alias("first_part"),
        )
    )
    days = (
        orders.groupBy("o_custkey", "o_orderdate")
        .agg(F.max("o_orderkey").alias("last_of_day"))
        .withColumn(
            "next_day",
            F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate")),
        )
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .drop("c_custkey")
    )
    visits = (
        orders.join(days, ["o_custkey", "o_orderdate"])
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts, F.col("first_part") == F.col("p_partkey"))
    )
    # Orders of one day follow each other by key.
    next_order = F.when(F.col("o_orderkey") < F.col("last_of_day"), F.col("o_orderdate")).otherwise(
        F.col("next_day")
    )
    return visits.withColumn("_next", next_order).select(*_encounter_columns())


def _encounter_columns() -> list:
    age = (F.col("o_custkey") % 100).cast("int")
    decade = F.floor(age / 10).cast("int")
    order = F.col("o_orderkey")
    bands = F.array(*[F.lit(band) for band, _ in AGE_BANDS])
    a1c = F.array(F.lit("None"), F.lit("Norm"), F.lit(">7"), F.lit(">8"))
    within_30 = F.col("_next") < F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    columns = {
        "encounter_id": order,
        "patient_id": F.col("o_custkey"),
        "admission_date": F.col("o_orderdate"),
        "age": age,
        "age_numeric": 5 + 10 * decade,
        "age_group": F.get(bands, decade),
        "time_in_hospital": order % 15,
        "num_medications": F.col("min_qty"),
        "num_lab_procedures": F.col("sum_qty"),
        "num_procedures": F.col("n_ret"),
        "num_diagnoses": F.col("n_lines"),
        "primary_diagnosis": F.col("p_brand"),
        "discharge_disposition": F.col("o_orderstatus"),
        "discharge_disposition_id": F.col("c_nationkey"),
        "medical_specialty": F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")),
        "medical_specialty_id": F.col("c_nationkey") % 5,
        "admission_source": F.col("o_orderpriority"),
        "admission_source_id": F.col("c_nationkey"),
        "gender": F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male"),
        "a1c_result": F.get(a1c, (order % 4).cast("int")),
        "change": F.when(F.col("n_ret") > 0, "Ch").otherwise("No"),
        "diabetesMed": F.when(order % 3 == 0, "No").otherwise("Yes"),
        "readmitted": F.when(F.col("_next").isNull(), NOT_READMITTED)
        .when(within_30, READMITTED_WITHIN_30)
        .otherwise(READMITTED_AFTER_30),
    }
    return [
        columns[field.name].cast(field.dataType).alias(field.name) for field in ENCOUNTER_SCHEMA
    ]


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    """The fact table, derived once per application and then read by every report."""
    return shared_table(spark, "encounters", folder, lambda: build_encounters(spark, folder))


def _every(number: int) -> Column:
    return F.col("encounter_id") % number == 0


def encounters_with_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters with planted NULLs, impossible ages and second copies."""
    clean = encounters(spark, folder).select(
        "encounter_id",
        "patient_id",
        "admission_date",
        "age",
        "age_group",
        "primary_diagnosis",
        "readmitted",
        "discharge_disposition",
        "time_in_hospital",
    )
    defective = clean.withColumns(
        {
            "patient_id": F.when(~_every(83), F.col("patient_id")),
            "admission_date": F.when(~_every(103), F.col("admission_date")),
            "age": F.when(_every(101), 150).otherwise(F.col("age")),
            "primary_diagnosis": F.when(~_every(89), F.col("primary_diagnosis")),
            "readmitted": F.when(~_every(79), F.col("readmitted")),
        }
    )
    return defective.unionByName(clean.where(_every(97)))


def raw_text_encounters(spark: SparkSession, folder: str) -> DataFrame:
    """The raw extract as text, with whole numbers written as decimals and unreadable ones."""
    raw = raw_encounters(spark, folder)
    stay, drugs = F.col("time_in_hospital").cast("string"), F.col("num_medications").cast("string")
    return raw.select(*[F.col(name).cast("string").alias(name) for name in raw.columns]).withColumns(
        {
            "time_in_hospital": F.when(_every(13), F.concat(stay, F.lit(".0")))
            .when(_every(83), F.concat(stay, F.lit(" days")))
            .otherwise(stay),
            "num_medications": F.when(_every(97), F.concat(drugs, F.lit(".5"))).otherwise(drugs),
        }
    )


def raw_encounters(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters in the shape of a raw extract, with missing markers and odd counts."""
    missing = F.lit(MISSING_MARKER)
    return encounters(spark, folder).select(
        "encounter_id",
        F.col("patient_id").alias("patient_nbr"),
        F.when(_every(53), missing).otherwise(F.col("age_group")).alias("age"),
        F.when(~_every(59), F.col("time_in_hospital")).alias("time_in_hospital"),
        "num_lab_procedures",
        "num_procedures",
        F.when(_every(61), 0)
        .when(_every(67), 101)
        .otherwise(F.col("num_medications"))
        .alias("num_medications"),
        F.when(_every(71), 0).otherwise(F.col("num_diagnoses")).alias("number_diagnoses"),
        F.when(_every(73), missing).otherwise(F.col("primary_diagnosis")).alias("diag_1"),
        F.col("a1c_result").alias("A1Cresult"),
        "change",
        "diabetesMed",
        F.when(_every(79), missing).otherwise(F.col("readmitted")).alias("readmitted"),
    )


#: Kinds of files of the written extract: two column orders, and one with notes over several lines.
_PLAIN, _REVERSED, _WITH_NOTES = range(3)


def _quoted(value: Column) -> Column:
    doubled = F.replace(value, F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), doubled, F.lit('"'))


def extract_files(spark: SparkSession, folder: str) -> str:
    """The raw extract as CSV files, written once per application; returns their folder.

    A third of the files has the columns in reverse, a third an extra column whose quoted
    notes hold quotes and line ends. Every 89th row of the others is broken: it lacks its last
    field or has one too many. Missing values are written as the marker.
    """

    def write(path: str) -> None:
        raw = raw_text_encounters(spark, folder)
        marker = F.lit(MISSING_MARKER)
        fields = {name: _quoted(F.coalesce(F.col(name), marker)) for name in raw.columns}
        note = _quoted(F.concat(F.lit('seen "twice",\non day '), F.col("time_in_hospital")))
        orders = [list(fields), list(fields)[::-1], [*fields, "note"]]
        kind = (F.col("encounter_id").cast("long") % 3).cast("int")
        lines = [
            F.concat_ws(",", *[fields.get(name, F.coalesce(note, marker)) for name in names]) for names in orders
        ]
        short = F.concat_ws(",", *[fields[name] for name in list(fields)[:-1]])
        line = (
            F.when(kind == _WITH_NOTES, lines[_WITH_NOTES])
            .when(_every(178), F.concat(lines[_PLAIN], F.lit(",1")))
            .when(_every(89), short)
            .when(kind == _REVERSED, lines[_REVERSED])
            .otherwise(lines[_PLAIN])
        )
        # A task writes a file per kind; its header sorts before its rows.
        files = int(spark.conf.get("spark.sql.shuffle.partitions"))
        place = F.pmod(F.hash("encounter_id"), F.lit(files)) * 3 + kind
        rows = raw.select(place.alias("part"), F.lit(1).alias("rank"), line.alias("value"))
        headers = F.array(*[F.lit(",".join(names)) for names in orders])
        heads = spark.range(3 * files).select(
            F.col("id").cast("int").alias("part"),
            F.lit(0).alias("rank"),
            F.get(headers, (F.col("id") % 3).cast("int")).alias("value"),
        )
        (
            rows.unionByName(heads)
            .repartition("part")
            .sortWithinPartitions("part", "rank")
            .select("part", "value")
            .write.mode("overwrite")
            .partitionBy("part")
            .text(path)
        )

    return shared_files(spark, "extract", folder, write)
