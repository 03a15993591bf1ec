"""The encounter model: one canonical name and type per column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.fixed_values import MISSING_MARKER

ENCOUNTER_SCHEMA = T.StructType(
    [
        T.StructField("encounter_id", T.LongType()),
        T.StructField("patient_id", T.LongType()),
        T.StructField("admission_date", T.TimestampNTZType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("age_numeric", T.IntegerType()),
        T.StructField("age_group", T.StringType()),
        T.StructField("time_in_hospital", T.IntegerType()),
        T.StructField("num_medications", T.IntegerType()),
        T.StructField("num_lab_procedures", T.IntegerType()),
        T.StructField("num_procedures", T.IntegerType()),
        T.StructField("num_diagnoses", T.IntegerType()),
        T.StructField("primary_diagnosis", T.StringType()),
        T.StructField("discharge_disposition", T.StringType()),
        T.StructField("discharge_disposition_id", T.IntegerType()),
        T.StructField("medical_specialty", T.StringType()),
        T.StructField("medical_specialty_id", T.IntegerType()),
        T.StructField("admission_source", T.StringType()),
        T.StructField("admission_source_id", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("a1c_result", T.StringType()),
        T.StructField("change", T.StringType()),
        T.StructField("diabetesMed", T.StringType()),
        T.StructField("readmitted", T.StringType()),
    ]
)

# Columns normalization reads, the names a raw extract may give them, and their
# type. When an extract carries several of the names, the first non-null wins.
RAW_COLUMNS = (
    ("encounter_id", ("encounter_id",), "bigint"),
    ("patient_id", ("patient_nbr", "patient_id"), "bigint"),
    ("age_group", ("age", "age_group"), "string"),
    ("time_in_hospital", ("time_in_hospital",), "int"),
    ("num_lab_procedures", ("num_lab_procedures",), "int"),
    ("num_procedures", ("num_procedures",), "int"),
    ("num_medications", ("num_medications",), "int"),
    ("num_diagnoses", ("number_diagnoses", "num_diagnoses"), "int"),
    ("primary_diagnosis", ("diag_1", "primary_diagnosis"), "string"),
    ("a1c_result", ("A1Cresult", "a1c_result"), "string"),
    ("change", ("change",), "string"),
    ("diabetesMed", ("diabetesMed",), "string"),
    ("readmitted", ("readmitted",), "string"),
)


# Columns a raw extract may carry; reports on a period need them.
OPTIONAL_COLUMNS = (("admission_date", ("admission_date",), "timestamp_ntz"),)


def _marked(df: DataFrame, name: str) -> Column:
    """The raw value, NULL where the extract marks it as missing."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.StringType):
        column = F.nullif(column, F.lit(MISSING_MARKER))
    return column


def _cleaned(df: DataFrame, name: str, type_name: str) -> Column:
    """The typed value, NULL where it is missing or cannot be read.

    Whole numbers may be written with a fraction of zeros: tools that hold a column
    with missing values as floating point write 7 as `7.0`.
    """
    column = _marked(df, name)
    if isinstance(df.schema[name].dataType, T.StringType) and type_name != "string":
        if type_name in ("int", "bigint"):
            number = column.try_cast("decimal(38,9)")
            column = F.when(number == F.floor(number), number).try_cast(type_name)
        else:
            column = column.try_cast(type_name)
    return column.cast(type_name)


def _columns(df: DataFrame) -> list[tuple[str, list[str], str]]:
    """Canonical name, names found in the extract and type of every column of the model."""
    present = set(df.columns)
    columns = [
        (canonical, [alias for alias in aliases if alias in present], type_name)
        for canonical, aliases, type_name in (*RAW_COLUMNS, *OPTIONAL_COLUMNS)
    ]
    optional = {canonical for canonical, _, _ in OPTIONAL_COLUMNS}
    absent = [
        " or ".join(aliases)
        for (canonical, found, _), (_, aliases, _) in zip(columns, (*RAW_COLUMNS, *OPTIONAL_COLUMNS), strict=True)
        if not found and canonical not in optional
    ]
    if absent:
        raise ValueError(f"raw extract lacks: {', '.join(absent)}")
    return [column for column in columns if column[1]]


def _value(df: DataFrame, found: list[str], type_name: str) -> Column:
    values = [_cleaned(df, alias, type_name) for alias in found]
    return F.coalesce(*values) if len(values) > 1 else values[0]


def unreadable_mask(df: DataFrame) -> Column:
    """One bit per column of the model: the extract has a value there that cannot be read."""
    bits = F.lit(0).cast("bigint")
    for place, (_, found, type_name) in enumerate(_columns(df)):
        given = F.coalesce(*[_marked(df, alias).cast("string") for alias in found]).isNotNull()
        lost = given & _value(df, found, type_name).isNull()
        bits = bits.bitwiseOR(F.when(lost, F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def unreadable_values(canonical: DataFrame, mask: str = "unreadable") -> DataFrame:
    """Per column of the model the values given and the unreadable ones among them.

    Unreadable values are NULL in the canonical frame, which alone would not tell
    them from missing ones; the frame carries their `unreadable_mask`.
    """
    names = [field for field, _, _ in (*RAW_COLUMNS, *OPTIONAL_COLUMNS) if field in canonical.columns]
    lost = [F.count_if(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0).alias(f"{n}|lost") for i, n in enumerate(names)]
    row = canonical.agg(*[F.count(name).alias(f"{name}|read") for name in names], *lost)
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            (F.col(f"`{name}|read`") + F.col(f"`{name}|lost`")).alias("given_values"),
            F.col(f"`{name}|lost`").alias("unreadable_values"),
        )
        for name in names
    ]
    return row.select(F.inline(F.array(*entries)))


def canonicalize(df: DataFrame, *extra: Column) -> DataFrame:
    """Project a raw extract onto the canonical names and types, and `extra` columns.

    The missing marker becomes NULL and columns outside the model are ignored. An
    absent column is an error, raised here rather than in the middle of a report;
    the admission date alone may be absent.
    """
    projected = [_value(df, found, type_name).alias(canonical) for canonical, found, type_name in _columns(df)]
    return df.select(*projected, *extra)
