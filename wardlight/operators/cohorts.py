"""Risk cohorts: diagnoses, ages, medication tiers, correlations."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.fixed_values import (
    CORRELATED_COLUMNS,
    MIN_DIAGNOSIS_CASES,
    OPPORTUNITY_RATE_PCT,
    RISK_CUTS_PCT,
    RISK_FLAGS,
    RISK_LEVELS,
)
from wardlight.functions.banding import medication_tier
from wardlight.functions.measures import (
    graded,
    rate_pct,
    readmissions_30d,
    rounded_mean,
    rounded_pct,
)


def diagnosis_risk(
    encounters: DataFrame, min_cases: int = MIN_DIAGNOSIS_CASES, top: int = 20
) -> DataFrame:
    """Diagnoses with the highest 30-day rate among those with enough cases.

    An unknown diagnosis is a cohort of its own here. Equal rates are ordered by
    diagnosis so that the limit always keeps the same rows.
    """
    return (
        encounters.groupBy("primary_diagnosis")
        .agg(
            F.count("*").alias("total_cases"),
            readmissions_30d().alias("readmissions_30d"),
            rounded_mean("time_in_hospital").alias("avg_los"),
            rounded_mean("num_medications").alias("avg_medications"),
        )
        .where(F.col("total_cases") >= min_cases)
        .select(
            "primary_diagnosis",
            "total_cases",
            "readmissions_30d",
            rounded_pct(F.col("readmissions_30d"), F.col("total_cases")).alias(
                "readmission_rate_pct"
            ),
            "avg_los",
            "avg_medications",
            graded(
                rate_pct(F.col("readmissions_30d"), F.col("total_cases")),
                RISK_CUTS_PCT,
                RISK_FLAGS,
            ).alias("risk_flag"),
        )
        .orderBy(F.desc("readmission_rate_pct"), F.asc_nulls_last("primary_diagnosis"))
        .limit(top)
    )


def diagnosis_stats(
    clean: DataFrame, min_cases: int = MIN_DIAGNOSIS_CASES, top: int | None = None
) -> DataFrame:
    """Same question on the normalized frame: known diagnoses only, nothing rounded."""
    stats = (
        clean.where(F.col("primary_diagnosis").isNotNull())
        .groupBy("primary_diagnosis")
        .agg(
            F.count("*").alias("total"),
            F.sum("readmitted_30d").alias("readmissions"),
            F.avg("time_in_hospital").alias("avg_los"),
            F.avg("num_medications").alias("avg_meds"),
        )
        .where(F.col("total") >= min_cases)
        .withColumn(
            "readmission_rate", F.col("readmissions").cast("double") / F.col("total").cast("double")
        )
        .withColumn(
            "risk_level",
            graded(rate_pct(F.col("readmissions"), F.col("total")), RISK_CUTS_PCT, RISK_LEVELS),
        )
        .orderBy(F.desc("readmission_rate"), "primary_diagnosis")
    )
    return stats if top is None else stats.limit(top)


def service_opportunities(
    encounters: DataFrame,
    threshold_pct: float = OPPORTUNITY_RATE_PCT,
    min_cases: dict[str, int] | None = None,
    dimensions: tuple = ("primary_diagnosis", "age_group", "discharge_disposition"),
    flagged_only: bool = False,
) -> DataFrame:
    """Cohorts ranked by 30-day rate within each dimension, flagged at a threshold.

    `min_cases` is the least size of a cohort by dimension; by default diagnoses alone
    have one. All dimensions come from one scan: each encounter is unpivoted to one row per
    dimension and combined map-side, so only cohort totals are shuffled.
    """
    least = F.lit(0)
    for dimension, cases in (min_cases or {"primary_diagnosis": MIN_DIAGNOSIS_CASES}).items():
        least = F.when(F.col("dimension") == dimension, F.lit(cases)).otherwise(least)
    cohorts = (
        encounters.unpivot("readmitted", list(dimensions), "dimension", "cohort")
        .where(F.col("cohort").isNotNull())
        .groupBy("dimension", "cohort")
        .agg(F.count("*").alias("total_cases"), readmissions_30d().alias("readmissions_30d"))
        .where(F.col("total_cases") >= least)
        .withColumn("_rate", rate_pct(F.col("readmissions_30d"), F.col("total_cases")))
    )
    if flagged_only:
        cohorts = cohorts.where(F.col("_rate") >= threshold_pct)
    ranking = W.partitionBy("dimension").orderBy(F.desc("_rate"))
    return cohorts.select(
        "dimension",
        F.rank().over(ranking).alias("opportunity_rank"),
        "cohort",
        "total_cases",
        "readmissions_30d",
        rounded_pct(F.col("readmissions_30d"), F.col("total_cases")).alias("readmission_rate_pct"),
        (F.col("_rate") >= threshold_pct).cast("int").alias("intervention_flag"),
    ).orderBy("dimension", "opportunity_rank", "cohort")


def age_cohort_rank(encounters: DataFrame) -> DataFrame:
    """Age groups with their averages, ranked by 30-day rate; ties leave gaps."""
    cohorts = (
        encounters.groupBy("age_group")
        .agg(
            F.count("*").alias("total_patients"),
            rounded_mean("time_in_hospital").alias("avg_los"),
            rounded_mean("num_medications").alias("avg_medications"),
            rounded_mean("num_lab_procedures").alias("avg_lab_procedures"),
            readmissions_30d().alias("readmissions_30d"),
        )
        .withColumn("_rate", rate_pct(F.col("readmissions_30d"), F.col("total_patients")))
    )
    # One row per age group by now.
    return cohorts.select(
        "age_group",
        "total_patients",
        "avg_los",
        "avg_medications",
        "avg_lab_procedures",
        "readmissions_30d",
        rounded_pct(F.col("readmissions_30d"), F.col("total_patients")).alias(
            "readmission_rate_pct"
        ),
        F.rank().over(W.orderBy(F.desc("_rate"))).alias("risk_rank"),
    ).orderBy(F.desc("readmission_rate_pct"), F.asc_nulls_last("age_group"))


def medication_tiers(encounters: DataFrame) -> DataFrame:
    """Cohorts by number of medications, in the order of their mean count."""
    return (
        encounters.withColumn("medication_tier", medication_tier(F.col("num_medications")))
        .groupBy("medication_tier")
        .agg(
            F.count("*").alias("patient_count"),
            rounded_mean("time_in_hospital").alias("avg_los"),
            rounded_mean("num_diagnoses").alias("avg_diagnoses"),
            readmissions_30d().alias("readmissions_30d"),
            rounded_pct(readmissions_30d(), F.count("*")).alias("readmission_rate_pct"),
            F.avg("num_medications").alias("_mean_count"),
        )
        .orderBy(F.asc_nulls_last("_mean_count"), "medication_tier")
        .drop("_mean_count")
    )


def correlation_pairs(clean: DataFrame, columns: tuple = CORRELATED_COLUMNS) -> DataFrame:
    """Pearson correlation of every pair of columns, each pair over its complete rows.

    The lower triangle of the matrix as (x, y, corr) rows. A column that is constant
    on a pair's rows has no correlation (NULL); the result is never NaN.

    A first narrow scan finds the mean of every column. The sums are taken around it,
    as sums of the plain values would cancel where a column is far from zero.

    Rows are grouped by which columns they know, a handful of groups, with one sum
    per column and product; a pair then adds up the groups that know both. That
    keeps the aggregate over the encounters narrow enough for generated code, which
    a moment aggregate per pair is not.
    """
    bit = {name: 1 << place for place, name in enumerate(columns)}
    means = clean.agg(*[F.avg(name).alias(name) for name in columns]).first()
    centre = {name: float(means[name] or 0.0) for name in columns}
    value = {name: f"coalesce(cast(`{name}` AS double) - {centre[name]!r}D, 0D)" for name in columns}
    known = " + ".join(f"if(`{name}` IS NULL, 0, {bit[name]})" for name in columns)
    sums = [f"sum({value[name]}) AS `s|{name}`" for name in columns]
    sums += [
        f"sum({value[x]} * {value[y]}) AS `s|{x}|{y}`"
        for place, x in enumerate(columns)
        for y in columns[: place + 1]
    ]
    bounds = [
        f"cast({bound}(`{name}`) AS double) AS `{bound}|{name}`"
        for bound in ("min", "max")
        for name in columns
    ]
    groups = clean.groupBy(F.expr(known).alias("known")).agg(
        *[F.expr(measure) for measure in ["cast(count(*) AS double) AS n", *sums, *bounds]]
    )
    entries = [
        f"'{x}', '{y}', known & {bit[x] | bit[y]} = {bit[x] | bit[y]}, n, `s|{x}`, `s|{y}`, "
        f"`s|{x}|{x}`, `s|{y}|{y}`, `s|{x}|{y}`, `min|{x}`, `max|{x}`, `min|{y}`, `max|{y}`"
        for x, y in combinations(reversed(columns), 2)
    ]
    totals = (
        groups.selectExpr(
            f"stack({len(entries)}, {', '.join(entries)}) AS "
            "(x, y, complete, n, sx, sy, sxx, syy, sxy, x_min, x_max, y_min, y_max)"
        )
        .groupBy("x", "y")
        .agg(
            *[
                F.expr(f"sum({name}) FILTER (WHERE complete) AS {name}")
                for name in ("n", "sx", "sy", "sxx", "syy", "sxy")
            ],
            *[
                F.expr(
                    f"min({name}_min) FILTER (WHERE complete) < "
                    f"max({name}_max) FILTER (WHERE complete) AS {name}_varies"
                )
                for name in ("x", "y")
            ],
        )
    )
    mean_x, mean_y = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    covariance = F.col("sxy") / F.col("n") - mean_x * mean_y
    nothing = F.lit(0.0)
    spread = F.sqrt(F.greatest(F.col("sxx") / F.col("n") - mean_x * mean_x, nothing)) * F.sqrt(
        F.greatest(F.col("syy") / F.col("n") - mean_y * mean_y, nothing)
    )
    varies = F.col("x_varies") & F.col("y_varies")
    corr = F.when(varies, covariance / F.nullif(spread, nothing))
    return totals.select("x", "y", corr.alias("corr"))
