"""Aggregate measures shared by the reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight.fixed_values import READMITTED_WITHIN_30

# Wide enough for any row count or sum of counts; division keeps 14+ decimals.
_EXACT = "decimal(20,0)"


def readmissions_30d(outcome: str = "readmitted") -> Column:
    """Number of encounters readmitted within 30 days."""
    return outcome_count(READMITTED_WITHIN_30, outcome)


def outcome_count(code: str, outcome: str = "readmitted") -> Column:
    return F.sum(F.when(F.col(outcome) == code, 1).otherwise(0))


def rate_pct(part: Column, whole: Column) -> Column:
    """Unrounded percentage; NULL when there is nothing to divide by.

    The quotient of two exact integers, so comparing it with a threshold such as
    11.0 is exact.
    """
    return (part * 100).cast("double") / F.nullif(whole, F.lit(0)).cast("double")


def rounded_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded half up, computed in decimals so that ties are real."""
    quotient = part.cast(_EXACT) * 100 / F.nullif(whole, F.lit(0)).cast(_EXACT)
    return F.round(quotient, digits).cast("double")


def rounded_mean(column: str, digits: int = 2) -> Column:
    """Mean of an integer column rounded half up, NULLs skipped."""
    return rounded_ratio(F.sum(column), F.count(column), digits)


def rounded_ratio(total: Column, rows: Column, digits: int = 2) -> Column:
    """Quotient of two integers rounded half up; NULL when there is nothing to divide by."""
    quotient = total.cast(_EXACT) / F.nullif(rows, F.lit(0)).cast(_EXACT)
    return F.round(quotient, digits).cast("double")


def graded(rate: Column, cuts: tuple, labels: tuple) -> Column:
    """Label of the first cut the rate reaches, the last label otherwise."""
    grade = F.when(rate >= cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:]):
        grade = grade.when(rate >= cut, label)
    return grade.otherwise(labels[-1])
