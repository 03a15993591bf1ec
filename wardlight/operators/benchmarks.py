"""Reports that bring in dimension tables and compare groups with a benchmark."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import MIN_BENCHMARK_ENCOUNTERS
from wardlight.functions.measures import rate_pct, readmissions_30d, rounded_mean, rounded_pct
from wardlight.sources.lookups import with_lookup


def disposition_impact(encounters: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Discharge dispositions from worst to best rate with a running total.

    `dispositions` has the key `disposition_id`.
    """
    groups = (
        with_lookup(encounters, "discharge_disposition_id", dispositions, "disposition_id")
        .groupBy("discharge_disposition")
        .agg(
            F.count("*").alias("total_discharges"),
            readmissions_30d().alias("readmissions_30d"),
            rounded_mean("time_in_hospital").alias("avg_los"),
        )
        .withColumn("_rate", rate_pct(F.col("readmissions_30d"), F.col("total_discharges")))
    )
    # One row per disposition by now.
    so_far = W.orderBy(F.desc("_rate"), F.asc_nulls_last("discharge_disposition")).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return groups.select(
        "discharge_disposition",
        "total_discharges",
        "readmissions_30d",
        rounded_pct(F.col("readmissions_30d"), F.col("total_discharges")).alias(
            "readmission_rate_pct"
        ),
        "avg_los",
        F.sum("total_discharges").over(so_far).alias("cumulative_discharges"),
    ).orderBy(F.desc("readmission_rate_pct"), F.asc_nulls_last("discharge_disposition"))


def specialty_source_benchmark(
    encounters: DataFrame,
    specialties: DataFrame,
    sources: DataFrame,
    min_encounters: int = MIN_BENCHMARK_ENCOUNTERS,
) -> DataFrame:
    """Specialty by admission source against the mean rate of the reported groups.

    The benchmark is the unweighted mean over the groups that are large enough,
    so it is taken after the size filter. `specialties` has the key
    `specialty_id`, `sources` the key `source_id`.
    """
    joined = with_lookup(encounters, "medical_specialty_id", specialties, "specialty_id")
    joined = with_lookup(joined, "admission_source_id", sources, "source_id")
    groups = (
        joined.where(F.col("medical_specialty").isNotNull())
        .groupBy("medical_specialty", "admission_source")
        .agg(
            F.countDistinct("patient_id").alias("unique_patients"),
            F.count("*").alias("encounters"),
            rounded_mean("time_in_hospital").alias("avg_los"),
            readmissions_30d().alias("readmissions_30d"),
        )
        .where(F.col("encounters") >= min_encounters)
        .withColumn("_rate", rate_pct(F.col("readmissions_30d"), F.col("encounters")))
    )
    # One row per reported group by now.
    benchmark = F.avg("_rate").over(W.partitionBy())
    return groups.select(
        "medical_specialty",
        "admission_source",
        "unique_patients",
        "encounters",
        "avg_los",
        "readmissions_30d",
        rounded_pct(F.col("readmissions_30d"), F.col("encounters")).alias("readmission_rate_pct"),
        F.round(benchmark, 2).alias("overall_avg_rate"),
        F.round(F.col("_rate") - benchmark, 2).alias("variance_from_benchmark"),
    ).orderBy(
        F.desc("readmission_rate_pct"),
        "medical_specialty",
        F.asc_nulls_last("admission_source"),
    )
