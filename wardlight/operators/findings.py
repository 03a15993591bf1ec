"""Measured versions of the findings a client report states."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.measures import rate_pct
from wardlight.operators.one_row import OneRow, alone, value_within


def _rate_where(condition: Column) -> Column:
    hits = F.sum(F.when(condition, F.col("readmitted_30d")))
    return rate_pct(hits, F.count_if(condition))


def _with_ratio(rates: DataFrame, numerator: str, denominator: str) -> DataFrame:
    return rates.withColumn(
        "rate_ratio", F.col(numerator) / F.nullif(F.col(denominator), F.lit(0.0))
    )


def polypharmacy_ratio(clean: DataFrame, cutoff: int = 20) -> DataFrame:
    """How much higher the 30-day rate is from `cutoff` medications upwards."""
    return alone(clean, polypharmacy_part(cutoff))


def polypharmacy_part(cutoff: int = 20, within: Column | None = None) -> OneRow:
    """`polypharmacy_ratio` of the rows for which `within` holds."""
    many = value_within("num_medications", within) >= cutoff
    measures = {
        "polypharmacy_encounters": F.count_if(many),
        "other_encounters": F.count_if(~many),
        "polypharmacy_rate_pct": _rate_where(many),
        "other_rate_pct": _rate_where(~many),
    }
    return OneRow(measures, lambda row: _with_ratio(row, "polypharmacy_rate_pct", "other_rate_pct"))


def top_diagnosis_share(clean: DataFrame, top: int = 5) -> DataFrame:
    """Share of all 30-day readmissions that the leading diagnoses account for.

    Encounters without a diagnosis count in the total but cannot lead.
    """
    per_diagnosis = clean.groupBy("primary_diagnosis").agg(
        F.sum("readmitted_30d").alias("readmissions")
    )
    # The unknown diagnosis sorts last instead of being filtered: a filter would move
    # into the scan and make the two branches below read the encounters twice.
    known = F.col("primary_diagnosis").isNotNull()
    leading = per_diagnosis.orderBy(
        F.desc(known), F.desc("readmissions"), "primary_diagnosis"
    ).limit(top)
    totals = per_diagnosis.agg(F.sum("readmissions").alias("_all"))
    return (
        leading.select(F.when(known, F.col("readmissions")).alias("_top"))
        .unionByName(totals, allowMissingColumns=True)
        .agg(
            F.coalesce(F.sum("_top"), F.lit(0)).alias("top_readmissions"),
            F.coalesce(F.sum("_all"), F.lit(0)).alias("total_readmissions"),
        )
        .withColumn(
            "share_pct", rate_pct(F.col("top_readmissions"), F.col("total_readmissions"))
        )
    )


def disposition_ratio(encounters: DataFrame, disposition: str, compared_with: str) -> DataFrame:
    """30-day rate after one discharge disposition relative to another.

    Works on any frame with `discharge_disposition` and `readmitted_30d`.
    """
    both = F.col("discharge_disposition").isin(disposition, compared_with)
    return alone(encounters.where(both), disposition_part(disposition, compared_with))


def disposition_part(disposition: str, compared_with: str, within: Column | None = None) -> OneRow:
    """`disposition_ratio` of the rows for which `within` holds."""
    value = value_within("discharge_disposition", within)
    measures = {
        "rate_pct": _rate_where(value == disposition),
        "compared_rate_pct": _rate_where(value == compared_with),
    }
    return OneRow(
        measures,
        lambda row: _with_ratio(row, "rate_pct", "compared_rate_pct").select(
            F.lit(disposition).alias("disposition"),
            "rate_pct",
            F.lit(compared_with).alias("compared_with"),
            "compared_rate_pct",
            "rate_ratio",
        ),
    )


def leading_age_bands(encounters: DataFrame, top: int = 2) -> DataFrame:
    """Age groups with the highest 30-day rate; ties at the last place all stay."""
    rates = (
        encounters.where(F.col("age_group").isNotNull())
        .groupBy("age_group")
        .agg(rate_pct(F.sum("readmitted_30d"), F.count("*")).alias("readmission_rate_pct"))
    )
    ranked = rates.withColumn("risk_rank", F.rank().over(W.orderBy(F.desc("readmission_rate_pct"))))
    return ranked.where(F.col("risk_rank") <= top).orderBy("risk_rank", "age_group")
