"""Ordered categories: age bands, medication tiers and bins."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    AGE_BANDS,
    MEDICATION_BINS,
    MEDICATION_TIER_REST,
    MEDICATION_TIERS,
)


def age_midpoint(band: Column) -> Column:
    """Midpoint of a ten-year band, NULL for anything that is not a band."""
    midpoints = F.create_map(*[F.lit(value) for entry in AGE_BANDS for value in entry])
    return F.try_element_at(midpoints, band)


def age_band_dimension(spark: SparkSession) -> DataFrame:
    return _dimension(spark, [band for band, _ in AGE_BANDS], "age_group", "band_order")


def medication_tier(count: Column) -> Column:
    """Left-closed tiers; an unknown count lands in the last one."""
    first_cut, first_label = MEDICATION_TIERS[0]
    tier = F.when(count < first_cut, first_label)
    for cut, label in MEDICATION_TIERS[1:]:
        tier = tier.when(count < cut, label)
    return tier.otherwise(MEDICATION_TIER_REST)


def medication_bin(count: Column) -> Column:
    """Right-closed bins; counts outside all of them get NULL."""
    low, high, label = MEDICATION_BINS[0]
    binned = F.when((count > low) & (count <= high), label)
    for low, high, label in MEDICATION_BINS[1:]:
        binned = binned.when((count > low) & (count <= high), label)
    return binned


def medication_bin_dimension(spark: SparkSession) -> DataFrame:
    labels = [label for *_, label in MEDICATION_BINS]
    return _dimension(spark, labels, "medication_bin", "bin_order")


def _dimension(spark: SparkSession, labels: list, name: str, order: str) -> DataFrame:
    """An inline table of labels in their order."""
    rows = ", ".join(f"('{label}', {place})" for place, label in enumerate(labels))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({name}, {order})")
