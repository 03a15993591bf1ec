"""Reports of one row: aggregates over a frame, and what is made of them.

Several such reports over one frame are one aggregate: the frame is read once, the row is
split afterwards.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OneRow:
    """Named aggregates, and the report from a frame with one row of them."""

    measures: dict[str, Column]
    report: Callable[[DataFrame], DataFrame]


def alone(frame: DataFrame, part: OneRow) -> DataFrame:
    """One report with a scan of its own."""
    return part.report(frame.agg(*[measure.alias(name) for name, measure in part.measures.items()]))


def all_measures(frame: DataFrame, parts: dict[str, OneRow]) -> DataFrame:
    """The aggregates of all reports in one row, each named report|measure."""
    return frame.agg(
        *[measure.alias(f"{name}|{own}") for name, part in parts.items() for own, measure in part.measures.items()]
    )


def split(row: DataFrame, parts: dict[str, OneRow]) -> dict[str, DataFrame]:
    """The reports from the row of `all_measures`."""
    return {
        name: part.report(row.select(*[F.col(f"`{name}|{own}`").alias(own) for own in part.measures]))
        for name, part in parts.items()
    }


def together(frame: DataFrame, parts: dict[str, OneRow]) -> dict[str, DataFrame]:
    """All reports from a single scan, which runs now; its one row goes through the driver."""
    measured = all_measures(frame, parts)
    row = frame.sparkSession.createDataFrame(measured.collect(), measured.schema)
    return split(row, parts)


def rows_within(within: Column | None) -> Column:
    """Number of the rows a condition holds for, of all rows without one."""
    return F.count("*") if within is None else F.count_if(within)


def value_within(name: str, within: Column | None) -> Column:
    """The value of a column where a condition holds, NULL elsewhere."""
    return F.col(name) if within is None else F.when(within, F.col(name))
