"""Headline figures, trends and the data behind the dashboard panels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    AGE_RATE_ALERT,
    BOX_GROUPS,
    KPI_NAMES,
    NOT_READMITTED,
    READMITTED_AFTER_30,
)
from wardlight.functions.banding import (
    age_band_dimension,
    medication_bin,
    medication_bin_dimension,
)
from wardlight.functions.measures import (
    outcome_count,
    rate_pct,
    readmissions_30d,
    rounded_mean,
    rounded_pct,
)
from wardlight.operators.one_row import OneRow, alone


def _over_groups(total: Column) -> Column:
    """A total over all groups. Only used on aggregates: one row per band or outcome."""
    return total.over(W.partitionBy())


def kpi_summary_part() -> OneRow:
    measures = {
        "unique_patients": F.countDistinct("patient_id"),
        "total_encounters": F.count("*"),
        "avg_length_of_stay": rounded_mean("time_in_hospital"),
        "avg_procedures_per_visit": rounded_mean("num_procedures"),
        "avg_medications": rounded_mean("num_medications"),
        "avg_lab_procedures": rounded_mean("num_lab_procedures"),
        "readmissions_30day": readmissions_30d(),
        "readmissions_after_30": outcome_count(READMITTED_AFTER_30),
        "no_readmission": outcome_count(NOT_READMITTED),
        "readmission_rate_30day_pct": rounded_pct(readmissions_30d(), F.count("*")),
    }
    return OneRow(measures, lambda row: row)


def kpi_summary(encounters: DataFrame) -> DataFrame:
    """One row of headline figures over all encounters."""
    return alone(encounters, kpi_summary_part())


def kpi_list(clean: DataFrame) -> DataFrame:
    """The headline figures of the normalized frame as (kpi, value) rows."""
    figures = (
        F.count("*").cast("double"),
        F.countDistinct("patient_id").cast("double"),
        F.avg("time_in_hospital"),
        F.avg("num_medications"),
        F.avg("num_lab_procedures"),
        rate_pct(F.sum("readmitted_30d"), F.count("*")),
        rate_pct(F.sum("readmitted_any"), F.count("*")),
    )
    row = clean.agg(*[figure.alias(name) for figure, name in zip(figures, KPI_NAMES)])
    return row.unpivot([], [F.col(f"`{name}`") for name in KPI_NAMES], "kpi", "value")


def quarterly_trend(encounters: DataFrame) -> DataFrame:
    return (
        encounters.groupBy(
            F.year("admission_date").alias("year"), F.quarter("admission_date").alias("quarter")
        )
        .agg(
            F.count("*").alias("total_admissions"),
            readmissions_30d().alias("readmissions_30d"),
            rounded_pct(readmissions_30d(), F.count("*")).alias("readmission_rate_pct"),
            rounded_mean("time_in_hospital").alias("avg_los"),
        )
        .orderBy(F.col("year").asc_nulls_last(), F.col("quarter").asc_nulls_last())
    )


def readmission_distribution(clean: DataFrame) -> DataFrame:
    """Encounters per known outcome, with the share of all encounters."""
    return (
        clean.groupBy("readmitted")
        .agg(F.count("*").alias("encounters"))
        .withColumn(
            "share_pct", rate_pct(F.col("encounters"), _over_groups(F.sum("encounters")))
        )
        .where(F.col("readmitted").isNotNull())
        .orderBy(F.desc("encounters"), "readmitted")
    )


def los_box_stats(clean: DataFrame) -> DataFrame:
    """Box-plot statistics of the length of stay per outcome group.

    Stays are whole days, so one pass reduces the encounters to a small
    (outcome, days) histogram and everything else is computed from that. The
    result is exact, and an outcome that holds most of the rows costs no more
    than the others.
    """
    labels = F.create_map(*[F.lit(value) for entry in BOX_GROUPS for value in entry])
    histogram = (
        clean.where(
            F.col("readmitted").isin(*[code for code, _ in BOX_GROUPS])
            & F.col("time_in_hospital").isNotNull()
        )
        .groupBy("readmitted", F.col("time_in_hospital").alias("days"))
        .agg(F.count("*").alias("n"))
    )
    quartiles = F.percentile("days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    per_group = W.partitionBy("readmitted")
    boxed = (
        histogram.withColumn("_q", quartiles.over(per_group))
        .withColumns({"q1": F.col("_q")[0], "median": F.col("_q")[1], "q3": F.col("_q")[2]})
        .withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
        .withColumn(
            "_inside",
            F.col("days").between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach")),
        )
    )
    inside_days = F.when(F.col("_inside"), F.col("days"))
    # A whisker never ends inside the box.
    summary = boxed.groupBy("readmitted", "q1", "median", "q3").agg(
        F.sum("n").alias("encounters"),
        F.least(F.min(inside_days).cast("double"), F.col("q1")).alias("whisker_low"),
        F.greatest(F.max(inside_days).cast("double"), F.col("q3")).alias("whisker_high"),
        F.sum(F.when(F.col("_inside"), 0).otherwise(F.col("n"))).alias("outliers"),
    )
    notch = 1.57 * (F.col("q3") - F.col("q1")) / F.sqrt(F.col("encounters"))
    return summary.select(
        F.try_element_at(labels, "readmitted").alias("outcome"),
        "encounters",
        "q1",
        "median",
        "q3",
        (F.col("median") - notch).alias("notch_low"),
        (F.col("median") + notch).alias("notch_high"),
        "whisker_low",
        "whisker_high",
        "outliers",
    )


def age_rate_panel(clean: DataFrame, alert: float = AGE_RATE_ALERT) -> DataFrame:
    """30-day rate of each of the ten age bands, absent bands included.

    `overall_rate` is the mean over every encounter, also over those whose band
    is not one of the ten.
    """
    per_band = (
        clean.groupBy("age_group")
        .agg(F.sum("readmitted_30d").alias("_readmitted"), F.count("*").alias("encounters"))
        .withColumn(
            "_overall",
            _share(_over_groups(F.sum("_readmitted")), _over_groups(F.sum("encounters"))),
        )
    )
    rate = _share(F.col("_readmitted"), F.col("encounters"))
    return (
        age_band_dimension(clean.sparkSession)
        .join(per_band, "age_group", "left")
        .select(
            "band_order",
            "age_group",
            F.translate("age_group", "[)", "").alias("label"),
            rate.alias("rate"),
            "encounters",
            F.coalesce(rate > alert, F.lit(False)).cast("int").alias("above_alert"),
            _over_groups(F.max("_overall")).alias("overall_rate"),
        )
        .orderBy("band_order")
    )


def medication_curve(clean: DataFrame) -> DataFrame:
    """30-day rate per medication bin, empty bins included."""
    per_bin = (
        clean.select(
            medication_bin(F.col("num_medications")).alias("medication_bin"), "readmitted_30d"
        )
        .where(F.col("medication_bin").isNotNull())
        .groupBy("medication_bin")
        .agg(rate_pct(F.sum("readmitted_30d"), F.count("*")).alias("readmission_rate_pct"))
    )
    return (
        medication_bin_dimension(clean.sparkSession)
        .join(per_bin, "medication_bin", "left")
        .select("bin_order", "medication_bin", "readmission_rate_pct")
        .orderBy("bin_order")
    )


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
