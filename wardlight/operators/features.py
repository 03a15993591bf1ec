"""Feature preparation, the train/test split and scaling statistics."""

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    A1C_MEASURED,
    COMPLEX_DIAGNOSES,
    FEMALE,
    MEDICATION_CHANGED,
    MODEL_FEATURES,
    MODEL_TARGET,
    ON_DIABETES_MEDICATION,
    POLYPHARMACY_MEDICATIONS,
    READMITTED_WITHIN_30,
    SPLIT_SEED,
    TEST_SHARE,
)
from wardlight.functions.flags import (
    all_known,
    flag_at_least,
    flag_equal,
    flag_in,
    ratio_zero_as_null,
)

_TWO_32 = 1 << 32
_PRIME = 2147483647
_FACTORS = (48271, 69621, 16807, 40692)
_SPREAD = 1664525
# The coarse buckets are the first 16 of 63 bits.
_COARSE_SHIFT = 47


def model_features(encounters: DataFrame) -> DataFrame:
    """Identified encounters with numeric features, rounded ratios, flags and target."""
    return encounters.where(
        F.col("patient_id").isNotNull() & F.col("encounter_id").isNotNull()
    ).select(
        "patient_id",
        "encounter_id",
        "age_numeric",
        "time_in_hospital",
        "num_lab_procedures",
        "num_procedures",
        "num_medications",
        "num_diagnoses",
        ratio_zero_as_null("num_lab_procedures", "time_in_hospital").alias("labs_per_day"),
        ratio_zero_as_null("num_medications", "num_diagnoses").alias("meds_per_diagnosis"),
        flag_equal("gender", FEMALE).alias("is_female"),
        flag_in("a1c_result", A1C_MEASURED).alias("has_a1c_result"),
        flag_equal("change", MEDICATION_CHANGED).alias("medication_changed"),
        flag_equal("diabetesMed", ON_DIABETES_MEDICATION).alias("on_diabetes_med"),
        flag_at_least("num_diagnoses", COMPLEX_DIAGNOSES).alias("complex_patient"),
        flag_at_least("num_medications", POLYPHARMACY_MEDICATIONS).alias("polypharmacy_flag"),
        flag_equal("readmitted", READMITTED_WITHIN_30).alias("readmitted_30d"),
    )


def model_frame(clean: DataFrame) -> DataFrame:
    """Encounters whose features and target are all known.

    Carries the encounter and patient numbers next to the model columns; they
    drive the split and the scores but are no features.
    """
    needed = [*MODEL_FEATURES, MODEL_TARGET]
    return clean.select("encounter_id", "patient_id", *needed).where(all_known(needed))


def split_hash(encounter_id: Column, seed: int = SPLIT_SEED) -> Column:
    """Pseudo-random number below 2**63 that depends on the encounter and seed only.

    The number is split into a quotient and a remainder by a prime. Two independent
    linear forms of them modulo that prime make the upper and the lower half, so
    different encounters get different hashes (up to the square of the prime, about
    4.6e18). Every product stays within 64 bits.
    """
    number = encounter_id.cast("bigint")
    prime = F.lit(_PRIME)
    low = F.pmod(number, prime)
    floored = F.call_function("div", number, prime) - (number % prime < 0).cast("bigint")
    high = F.pmod(floored, prime)
    upper = F.pmod(low * F.lit(_FACTORS[0]) + high * F.lit(_FACTORS[1]) + F.lit(seed), prime)
    lower = F.pmod(low * F.lit(_FACTORS[2]) + high * F.lit(_FACTORS[3]) + F.lit(seed), prime)
    return F.pmod(upper * F.lit(_SPREAD), F.lit(_TWO_32)) * F.lit(1 << 31) + lower


def stratified_split(
    frame: DataFrame,
    label: str = MODEL_TARGET,
    test_share=TEST_SHARE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Adds `is_test`: a reproducible split with the same label mix on both sides.

    The test side gets ceil(share * rows) encounters, divided over the labels by
    largest remainder. Within a label the encounters with the smallest hashes are
    taken. Copies of one encounter share a hash and thus a side, so a quota can be
    passed by copies of its last encounter.

    Counting which hashes those are runs when the split is made; the returned
    frame then compares a hash with one constant per label, without any join.
    """
    return with_side(frame, split_limits(frame, label, test_share, seed), label, seed)


def with_side(
    frame: DataFrame, limits: dict, label: str = MODEL_TARGET, seed: int = SPLIT_SEED
) -> DataFrame:
    """The frame with `is_test` from limits found before."""
    hashed = split_hash(F.col("encounter_id"), seed)
    in_test = F.lit(False)
    for value, limit in limits.items():
        in_test = in_test | ((F.col(label) == value) & (hashed <= limit))
    return frame.withColumn("is_test", F.coalesce(in_test, F.lit(False)).cast("int"))


def split_limits(
    frame: DataFrame,
    label: str = MODEL_TARGET,
    test_share=TEST_SHARE,
    seed: int = SPLIT_SEED,
) -> dict:
    """Per label the largest hash that still belongs to the test side.

    Found from counts alone, in two scans: 2**16 coarse buckets per label first,
    which also give the sizes of the labels, then the exact hashes of the one bucket
    the quota ends in, about 1/65536 of the label's rows. The driver sees one row per
    label.
    """
    hashed = frame.select(
        F.col(label).alias("label"), split_hash(F.col("encounter_id"), seed).alias("h")
    ).where(F.col("label").isNotNull() & F.col("h").isNotNull())
    coarse = hashed.groupBy("label", F.shiftright("h", _COARSE_SHIFT).alias("part")).count().persist()
    sizes = {
        row["label"]: row["count"]
        for row in coarse.groupBy("label").agg(F.sum("count").alias("count")).collect()
    }
    quotas = _test_quotas(sizes, test_share)
    if not quotas:
        coarse.unpersist()
        return {}
    ends_in = {
        row["label"]: (row["part"], row["open"])
        for row in _first_reaching(coarse, _per_label(quotas)).collect()
    }
    coarse.unpersist()
    last_bucket = _per_label({value: bucket for value, (bucket, _) in ends_in.items()})
    fine = (
        hashed.where(F.shiftright("h", _COARSE_SHIFT) == last_bucket)
        .groupBy("label", F.col("h").alias("part"))
        .count()
    )
    still_open = _per_label({value: remaining for value, (_, remaining) in ends_in.items()})
    return {
        row["label"]: row["part"] for row in _first_reaching(fine, still_open).collect()
    }


def _per_label(values: dict) -> Column:
    """The value that belongs to the label of a row, as a constant expression."""
    entries = iter(values.items())
    value, constant = next(entries)
    chosen = F.when(F.col("label") == value, F.lit(constant).cast("bigint"))
    for value, constant in entries:
        chosen = chosen.when(F.col("label") == value, F.lit(constant).cast("bigint"))
    return chosen


def _first_reaching(counts: DataFrame, quota: Column) -> DataFrame:
    """Per label the first part whose running count reaches the quota.

    `open` is what the parts before it leave of the quota. The window covers at
    most 2**16 counted parts per label.
    """
    before = F.sum("count").over(
        W.partitionBy("label").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        counts.withColumn("open", quota - F.coalesce(before, F.lit(0)))
        .where((F.col("open") > 0) & (F.col("count") >= F.col("open")))
        .select("label", "part", "open")
    )


def _test_quotas(sizes: dict, test_share) -> dict:
    """Test rows per label: the train side is apportioned, the rest is for testing."""
    total = sum(sizes.values())
    if total == 0:
        return {}
    train = total - math.ceil(Fraction(str(test_share)) * total)
    seats = {label: size * train // total for label, size in sizes.items()}
    by_remainder = sorted(sizes, key=lambda label: (-(sizes[label] * train % total), label))
    for label in by_remainder[: train - sum(seats.values())]:
        seats[label] += 1
    return {label: sizes[label] - seats[label] for label in sizes if sizes[label] > seats[label]}


def scaler_stats(split: DataFrame, features: tuple = MODEL_FEATURES) -> DataFrame:
    """Mean and population standard deviation of each feature on the training side.

    A constant feature is only centred: its scale is 1. `train_rows` is the number
    of rows the statistics rest on.
    """
    train = split.where(F.col("is_test") == 0)
    row = train.agg(
        F.count("*").alias("|rows"),
        *[F.avg(name).alias(f"{name}|mean") for name in features],
        *[F.stddev_pop(name).alias(f"{name}|std") for name in features],
    )
    entries = [
        F.struct(
            F.lit(name).alias("feature"),
            F.col(f"`{name}|mean`").alias("mean"),
            F.coalesce(F.nullif(F.col(f"`{name}|std`"), F.lit(0.0)), F.lit(1.0)).alias("scale"),
            F.col("`|rows`").alias("train_rows"),
        )
        for name in features
    ]
    return row.select(F.inline(F.array(*entries)))
