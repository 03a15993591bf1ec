"""Dimension tables of the encounter fact table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_key(dimension: DataFrame, key: str) -> DataFrame:
    """The dimension reduced to distinct known keys.

    A key that occurs twice would multiply the encounters joined to it.
    """
    return dimension.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_copies"))


def with_lookup(
    encounters: DataFrame, foreign_key: str, dimension: DataFrame, key: str
) -> DataFrame:
    """Left join to a dimension that contributes no columns to the report.

    The grouping makes the dimension provably unique on its key, which lets
    Catalyst drop the join. Where it stays, Spark picks the strategy from the
    dimension's size; nothing is broadcast by decree.
    """
    unique = one_row_per_key(dimension, key).select(F.col(key).alias(f"_{key}"))
    return encounters.join(unique, F.col(foreign_key) == F.col(f"_{key}"), "left").drop(f"_{key}")
