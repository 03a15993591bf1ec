"""Small frames for the operator tests."""

import datetime

from pyspark.sql import functions as F

from wardlight.schema import ENCOUNTER_SCHEMA

DAY = datetime.datetime(2020, 1, 15)

_USUAL = {
    "patient_id": 1,
    "admission_date": DAY,
    "age": 50,
    "age_numeric": 55,
    "age_group": "[50-60)",
    "time_in_hospital": 3,
    "num_medications": 7,
    "num_lab_procedures": 30,
    "num_procedures": 1,
    "num_diagnoses": 4,
    "primary_diagnosis": "250",
    "discharge_disposition": "Home",
    "discharge_disposition_id": 1,
    "medical_specialty": "Cardiology",
    "medical_specialty_id": 1,
    "admission_source": "Emergency",
    "admission_source_id": 1,
    "gender": "Female",
    "a1c_result": "Norm",
    "change": "Ch",
    "diabetesMed": "Yes",
    "readmitted": "NO",
}


def make_encounters(spark, *rows):
    """A fact table; each row overrides the usual values, `times` repeats it."""
    records, number = [], 0
    for row in rows:
        row = dict(row)
        for _ in range(row.pop("times", 1)):
            number += 1
            record = {**_USUAL, "encounter_id": number, **row}
            records.append(tuple(record[field.name] for field in ENCOUNTER_SCHEMA))
    return spark.createDataFrame(records, ENCOUNTER_SCHEMA)


def make_raw(spark, *rows):
    """A raw extract with the same overrides, in the extract's column names."""
    table = make_encounters(spark, *rows)
    return table.select(
        "encounter_id",
        F.col("patient_id").alias("patient_nbr"),
        F.col("age_group").alias("age"),
        "time_in_hospital",
        "num_lab_procedures",
        "num_procedures",
        "num_medications",
        F.col("num_diagnoses").alias("number_diagnoses"),
        F.col("primary_diagnosis").alias("diag_1"),
        F.col("a1c_result").alias("A1Cresult"),
        "change",
        "diabetesMed",
        "readmitted",
    )


def group(rate_hits, rate_rows, **values):
    """Rows of one cohort with an exact 30-day rate."""
    return (
        {"times": rate_hits, "readmitted": "<30", **values},
        {"times": rate_rows - rate_hits, "readmitted": "NO", **values},
    )


def rows_by(frame, key):
    return {row[key]: row for row in frame.collect()}
