"""0/1 flags and ratios derived per encounter.

Flags are integers because they get averaged and correlated. A missing input
never makes a flag NULL.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag_equal(column: str, value: str) -> Column:
    return F.col(column).eqNullSafe(value).cast("int")


def flag_not_equal(column: str, value: str) -> Column:
    return (~F.col(column).eqNullSafe(value)).cast("int")


def flag_at_least(column: str, minimum: int) -> Column:
    return F.coalesce(F.col(column) >= minimum, F.lit(False)).cast("int")


def flag_in(column: str, values: tuple) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False)).cast("int")


def flag_known_and_not(column: str, value: str) -> Column:
    return F.coalesce(F.col(column) != value, F.lit(False)).cast("int")


def ratio_zero_as_one(part: str, whole: str) -> Column:
    """Model variant of a ratio: a zero denominator counts as one."""
    denominator = F.when(F.col(whole) == 0, 1).otherwise(F.col(whole))
    return F.col(part).cast("double") / denominator.cast("double")


def ratio_zero_as_null(part: str, whole: str, digits: int = 2) -> Column:
    """Report variant of a ratio: NULL on a zero denominator, rounded half up."""
    denominator = F.nullif(F.col(whole), F.lit(0)).cast("decimal(10,0)")
    return F.round(F.col(part).cast("decimal(10,0)") / denominator, digits).cast("double")


def all_known(columns) -> Column:
    """Condition that no column is NULL, in a form Spark pushes into the scan."""
    return reduce(and_, [F.col(name).isNotNull() for name in columns])
