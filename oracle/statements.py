"""SQL that computes every registered query a second way, from the same tables.

Only the column names and the fixed values are shared with the library. Rounding
to two places is done on integers, half up, so that ties are exact.
"""

from wardlight.fixed_values import (
    AGE_BANDS,
    CORRELATED_COLUMNS,
    KPI_NAMES,
    MEDICATION_BINS,
    MODEL_FEATURES,
    MONTH_STATUS,
    PERIOD_STATUS,
    RISK_FLAGS,
    RISK_LEVELS,
)

_DECADES = ", ".join(f"({i}, '{band}', {mid})" for i, (band, mid) in enumerate(AGE_BANDS))

_ENCOUNTERS = f"""
decades(decade, band, midpoint) AS (VALUES {_DECADES}),
sequenced AS (
  SELECT *, LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_dt
  FROM orders
),
order_lines AS (
  SELECT l_orderkey, COUNT(*) AS n_lines, MIN(l_quantity) AS min_qty, SUM(l_quantity) AS sum_qty,
         COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_ret, MIN(l_partkey) AS first_part
  FROM lineitem GROUP BY l_orderkey
),
encounters AS (
  SELECT
    s.o_orderkey AS encounter_id, s.o_custkey AS patient_id, s.o_orderdate AS admission_date,
    CAST(s.o_custkey % 100 AS INT) AS age, CAST(d.midpoint AS INT) AS age_numeric, d.band AS age_group,
    CAST(s.o_orderkey % 15 AS INT) AS time_in_hospital,
    CAST(l.min_qty AS INT) AS num_medications, CAST(l.sum_qty AS INT) AS num_lab_procedures,
    CAST(l.n_ret AS INT) AS num_procedures, CAST(l.n_lines AS INT) AS num_diagnoses,
    p.p_brand AS primary_diagnosis, s.o_orderstatus AS discharge_disposition,
    c.c_nationkey AS discharge_disposition_id,
    NULLIF(c.c_mktsegment, 'FURNITURE') AS medical_specialty,
    CAST(c.c_nationkey % 5 AS INT) AS medical_specialty_id,
    s.o_orderpriority AS admission_source, c.c_nationkey AS admission_source_id,
    CASE s.o_custkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE s.o_orderkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Norm' WHEN 2 THEN '>7' ELSE '>8' END AS a1c_result,
    CASE WHEN l.n_ret > 0 THEN 'Ch' ELSE 'No' END AS change,
    CASE s.o_orderkey % 3 WHEN 0 THEN 'No' ELSE 'Yes' END AS diabetesMed,
    CASE WHEN s.next_dt IS NULL THEN 'NO'
         WHEN s.next_dt < s.o_orderdate + INTERVAL 30 DAY THEN '<30' ELSE '>30' END AS readmitted
  FROM sequenced s
  JOIN order_lines l ON l.l_orderkey = s.o_orderkey
  JOIN customer c ON c.c_custkey = s.o_custkey
  JOIN part p ON p.p_partkey = l.first_part
  JOIN decades d ON d.decade = (s.o_custkey % 100) // 10
)"""

_DIRTY = (
    _ENCOUNTERS
    + """,
dirty AS (
  SELECT encounter_id,
         CASE WHEN encounter_id % 83 <> 0 THEN patient_id END AS patient_id,
         CASE WHEN encounter_id % 103 <> 0 THEN admission_date END AS admission_date,
         CASE WHEN encounter_id % 101 = 0 THEN 150 ELSE age END AS age, age_group,
         CASE WHEN encounter_id % 89 <> 0 THEN primary_diagnosis END AS primary_diagnosis,
         CASE WHEN encounter_id % 79 <> 0 THEN readmitted END AS readmitted,
         discharge_disposition, time_in_hospital
  FROM encounters
  UNION ALL
  SELECT encounter_id, patient_id, admission_date, age, age_group, primary_diagnosis, readmitted,
         discharge_disposition, time_in_hospital
  FROM encounters WHERE encounter_id % 97 = 0
)"""
)

_NORM = (
    _ENCOUNTERS
    + """,
known AS (
  SELECT encounter_id, patient_id,
         CASE WHEN encounter_id % 53 <> 0 THEN age_group END AS age_group,
         CASE WHEN encounter_id % 59 <> 0 THEN time_in_hospital END AS time_in_hospital,
         num_lab_procedures, num_procedures,
         CASE WHEN encounter_id % 61 = 0 THEN 0 WHEN encounter_id % 67 = 0 THEN 101
              ELSE num_medications END AS num_medications,
         CASE WHEN encounter_id % 71 = 0 THEN 0 ELSE num_diagnoses END AS num_diagnoses,
         CASE WHEN encounter_id % 73 <> 0 THEN primary_diagnosis END AS primary_diagnosis,
         a1c_result, change, diabetesMed,
         CASE WHEN encounter_id % 79 <> 0 THEN readmitted END AS readmitted,
         CASE WHEN encounter_id % 53 <> 0 THEN age_numeric END AS age_numeric
  FROM encounters
),
norm AS (
  SELECT *,
    CAST(readmitted IS NOT DISTINCT FROM '<30' AS INT) AS readmitted_30d,
    CAST(readmitted IS DISTINCT FROM 'NO' AS INT) AS readmitted_any,
    CAST(change IS NOT DISTINCT FROM 'Ch' AS INT) AS medication_changed,
    CAST(diabetesMed IS NOT DISTINCT FROM 'Yes' AS INT) AS on_diabetes_med,
    CAST(a1c_result IS NOT NULL AND a1c_result <> 'None' AS INT) AS has_a1c_result,
    CAST(num_lab_procedures AS DOUBLE) / COALESCE(NULLIF(time_in_hospital, 0),
        CASE WHEN time_in_hospital = 0 THEN 1 END) AS labs_per_day,
    CAST(num_medications AS DOUBLE) / COALESCE(NULLIF(num_diagnoses, 0),
        CASE WHEN num_diagnoses = 0 THEN 1 END) AS meds_per_diagnosis,
    CAST(COALESCE(num_diagnoses, 0) >= 5 AS INT) AS complex_patient,
    CAST(COALESCE(num_medications, 0) >= 15 AS INT) AS polypharmacy_flag
  FROM known
)"""
)

# The CSV extract: rows whose fields do not fit are lost, numbers with a unit or a fraction unknown.
_BROKEN = "encounter_id % 89 = 0 AND encounter_id % 3 <> 2"
_EXTRACT = _NORM.replace(
    "norm AS (",
    f"""extract AS (
  SELECT * REPLACE (
    CASE WHEN encounter_id % 83 <> 0 OR encounter_id % 13 = 0 THEN time_in_hospital END AS time_in_hospital,
    CASE WHEN encounter_id % 97 <> 0 THEN num_medications END AS num_medications)
  FROM known WHERE NOT ({_BROKEN})
),
norm AS (""",
).replace("FROM known\n)", "FROM extract\n)")

_CLEAN = (
    _NORM
    + """,
clean AS (
  SELECT * FROM norm
  WHERE age_numeric IS NOT NULL AND time_in_hospital IS NOT NULL AND num_medications IS NOT NULL
)"""
)

_NORM_COLUMNS = (
    "encounter_id patient_id age_group time_in_hospital num_lab_procedures num_procedures "
    "num_medications num_diagnoses primary_diagnosis a1c_result change diabetesMed readmitted "
    "age_numeric readmitted_30d readmitted_any medication_changed on_diabetes_med has_a1c_result "
    "labs_per_day meds_per_diagnosis complex_patient polypharmacy_flag"
).split()

_R30 = "COUNT(*) FILTER (WHERE readmitted = '<30')"


def _half_up(numerator: str, denominator: str, digits: int = 2) -> str:
    scale = 10**digits
    return (
        f"CAST((2 * {scale} * CAST({numerator} AS HUGEINT) + ({denominator})) "
        f"// NULLIF(2 * ({denominator}), 0) AS DOUBLE) / {scale}"
    )


def _pct2(part: str, whole: str, digits: int = 2) -> str:
    return _half_up(f"100 * CAST({part} AS HUGEINT)", whole, digits)


def _mean2(column: str) -> str:
    return _half_up(f"SUM({column})", f"COUNT({column})")


def _pct(part: str, whole: str) -> str:
    return f"CAST(100 * ({part}) AS DOUBLE) / NULLIF({whole}, 0)"


def _with(prelude: str, body: str) -> str:
    return f"WITH {prelude}\n{body}"


def _quality() -> dict:
    checks = {
        "null_patient_id": "patient_id",
        "null_age": "age",
        "null_diagnosis": "primary_diagnosis",
        "null_readmitted": "readmitted",
        "null_discharge": "discharge_disposition",
    }
    limits = {name: 1.0 if column == "readmitted" else 5.0 for name, column in checks.items()}
    null_counts = ", ".join(
        f"NULLIF(COUNT(*) - COUNT({column}), 0) AS {name}" for name, column in checks.items()
    )
    profile = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS n FROM norm"
        for c in _NORM_COLUMNS
    )
    counted = {
        "encounter_id": ("encounter_id", "FALSE"),
        "patient_id": ("patient_id", "FALSE"),
        "age_group": ("age_group", "FALSE"),
        "time_in_hospital": ("time_in_hospital", "encounter_id % 83 = 0 AND encounter_id % 13 <> 0"),
        "num_lab_procedures": ("num_lab_procedures", "FALSE"),
        "num_procedures": ("num_procedures", "FALSE"),
        "num_medications": ("num_medications", "encounter_id % 97 = 0"),
        "num_diagnoses": ("num_diagnoses", "FALSE"),
        "primary_diagnosis": ("primary_diagnosis", "FALSE"),
        "a1c_result": ("a1c_result", "FALSE"),
        "change": ("change", "FALSE"),
        "diabetesMed": ("diabetesMed", "FALSE"),
        "readmitted": ("readmitted", "FALSE"),
    }
    unreadable = " UNION ALL ".join(
        f"SELECT '{name}' AS column_name, COUNT({column}) AS given_values, "
        f"COUNT(*) FILTER (WHERE {column} IS NOT NULL AND {odd}) AS unreadable_values FROM known"
        for name, (column, odd) in counted.items()
    )
    failures = " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, COUNT(*) - COUNT({column}) AS failed, {limits[name]} AS threshold_pct FROM dirty"
        for name, column in checks.items()
    )
    return {
        "dq_unreadable_values": _with(_NORM, unreadable),
        "input_profile": _with(
            _ENCOUNTERS, "SELECT COUNT(*) AS records, 13 AS features FROM encounters"
        ),
        "dq_null_counts": _with(
            _DIRTY,
            f"""SELECT COUNT(*) AS total_records, {null_counts},
                {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_pct FROM dirty""",
        ),
        "dq_age_out_of_range": _with(
            _DIRTY,
            """SELECT age_group, COUNT(*) AS record_count, MIN(time_in_hospital) AS min_los,
                 MAX(time_in_hospital) AS max_los, AVG(time_in_hospital) AS avg_los
               FROM dirty WHERE age < 0 OR age > 120 GROUP BY age_group""",
        ),
        "dq_duplicate_encounters": _with(
            _DIRTY,
            """SELECT encounter_id, duplicate_count
               FROM (SELECT encounter_id, COUNT(*) AS duplicate_count FROM dirty GROUP BY encounter_id)
               WHERE duplicate_count > 1""",
        ),
        "dq_null_profile": _with(
            _NORM,
            f"""SELECT column_name, null_count, {_pct('null_count', 'n')} AS null_pct
                FROM ({profile}) WHERE null_count > 0""",
        ),
        "dq_scorecard": _with(
            _DIRTY
            + f""",
nulls AS ({failures}),
total AS (SELECT COUNT(*) AS total_rows FROM dirty),
checks AS (
  SELECT check_name, failed, threshold_pct FROM nulls
  UNION ALL SELECT 'age_out_of_range', COUNT(*), 0.0 FROM dirty WHERE age < 0 OR age > 120
  UNION ALL SELECT 'duplicate_encounters', COUNT(*) - COUNT(DISTINCT encounter_id), 0.0 FROM dirty
)""",
            f"""SELECT check_name, CAST(failed AS BIGINT) AS failed, total_rows,
                  {_pct2('failed', 'total_rows', 4)} AS failed_pct,
                  CAST(threshold_pct AS DOUBLE) AS threshold_pct,
                  CAST(100.0 * failed / total_rows <= threshold_pct AS INT) AS passed
                FROM checks, total
                UNION ALL
                SELECT 'null_rate_thresholds', COUNT(*) FILTER (WHERE 100.0 * failed / total_rows > threshold_pct),
                  ANY_VALUE(total_rows), NULL, 0.0,
                  CAST(COUNT(*) FILTER (WHERE 100.0 * failed / total_rows > threshold_pct) = 0 AS INT)
                FROM nulls, total""",
        ),
        "norm_encounters": _with(
            _NORM,
            f"""SELECT {', '.join(_NORM_COLUMNS)} FROM norm""".replace(
                " age_numeric,", " CAST(age_numeric AS DOUBLE) AS age_numeric,"
            ).replace(
                " time_in_hospital,", " CAST(time_in_hospital AS DOUBLE) AS time_in_hospital,"
            ),
        ),
        "csv_extract": _with(
            _EXTRACT,
            f"""SELECT * EXCLUDE (age_numeric, time_in_hospital, num_medications),
                  CAST(age_numeric AS DOUBLE) AS age_numeric, CAST(time_in_hospital AS DOUBLE) AS time_in_hospital,
                  CAST(num_medications AS DOUBLE) AS num_medications
                FROM (SELECT {', '.join(_NORM_COLUMNS)} FROM norm)""",
        ),
        "dq_broken_rows": _with(
            _NORM,
            f"""SELECT COUNT(*) AS rows_read, COUNT(*) FILTER (WHERE {_BROKEN}) AS rows_broken, 0 AS rows_empty
                FROM known""",
        ),
        "norm_drop_critical": _with(
            _CLEAN,
            f"""SELECT b.n AS records_before, b.n - a.n AS records_removed, a.n AS records_after,
                  {_pct('a.hits', 'a.n')} AS readmission_rate_pct
                FROM (SELECT COUNT(*) AS n FROM norm) b,
                     (SELECT COUNT(*) AS n, COALESCE(SUM(readmitted_30d), 0) AS hits FROM clean) a""",
        ),
    }


def _descriptive() -> dict:
    figures = (
        "CAST(COUNT(*) AS DOUBLE)",
        "CAST(COUNT(DISTINCT patient_id) AS DOUBLE)",
        "AVG(time_in_hospital)",
        "AVG(num_medications)",
        "AVG(num_lab_procedures)",
        _pct("SUM(readmitted_30d)", "COUNT(*)"),
        _pct("SUM(readmitted_any)", "COUNT(*)"),
    )
    kpis = " UNION ALL ".join(
        f"SELECT '{name}' AS kpi, {figure} AS value FROM clean"
        for name, figure in zip(KPI_NAMES, figures)
    )
    bins = ", ".join(
        f"({order}, {low}, {high}, '{label}')"
        for order, (low, high, label) in enumerate(MEDICATION_BINS)
    )
    return {
        "kpi_summary": _with(
            _ENCOUNTERS,
            f"""SELECT COUNT(DISTINCT patient_id) AS unique_patients, COUNT(*) AS total_encounters,
                  {_mean2('time_in_hospital')} AS avg_length_of_stay,
                  {_mean2('num_procedures')} AS avg_procedures_per_visit,
                  {_mean2('num_medications')} AS avg_medications,
                  {_mean2('num_lab_procedures')} AS avg_lab_procedures,
                  {_R30} AS readmissions_30day,
                  COUNT(*) FILTER (WHERE readmitted = '>30') AS readmissions_after_30,
                  COUNT(*) FILTER (WHERE readmitted = 'NO') AS no_readmission,
                  {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_30day_pct
                FROM encounters""",
        ),
        "kpi_long": _with(_CLEAN, kpis),
        "quarterly_trend": _with(
            _ENCOUNTERS,
            f"""SELECT CAST(YEAR(admission_date) AS INT) AS year,
                  CAST(QUARTER(admission_date) AS INT) AS quarter,
                  COUNT(*) AS total_admissions, {_R30} AS readmissions_30d,
                  {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_pct,
                  {_mean2('time_in_hospital')} AS avg_los
                FROM encounters GROUP BY YEAR(admission_date), QUARTER(admission_date)""",
        ),
        "readmission_distribution": _with(
            _CLEAN,
            f"""SELECT readmitted, COUNT(*) AS encounters,
                  {_pct('COUNT(*)', '(SELECT COUNT(*) FROM clean)')} AS share_pct
                FROM clean WHERE readmitted IS NOT NULL GROUP BY readmitted""",
        ),
        "los_box_stats": _with(
            _CLEAN
            + """,
quartiles AS (
  SELECT readmitted, QUANTILE_CONT(time_in_hospital, 0.25) AS q1,
         QUANTILE_CONT(time_in_hospital, 0.5) AS median,
         QUANTILE_CONT(time_in_hospital, 0.75) AS q3, COUNT(*) AS n
  FROM clean WHERE readmitted IS NOT NULL GROUP BY readmitted
),
fenced AS (
  SELECT c.time_in_hospital AS days, q.*,
         c.time_in_hospital BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) AS inside
  FROM clean c JOIN quartiles q ON q.readmitted = c.readmitted
)""",
            """SELECT CASE readmitted WHEN 'NO' THEN 'No Readmit' WHEN '>30' THEN '>30 Days'
                      ELSE '<30 Days' END AS outcome,
                 n AS encounters, q1, median, q3,
                 median - 1.57 * (q3 - q1) / SQRT(n) AS notch_low,
                 median + 1.57 * (q3 - q1) / SQRT(n) AS notch_high,
                 LEAST(CAST(MIN(days) FILTER (WHERE inside) AS DOUBLE), q1) AS whisker_low,
                 GREATEST(CAST(MAX(days) FILTER (WHERE inside) AS DOUBLE), q3) AS whisker_high,
                 COUNT(*) FILTER (WHERE NOT inside) AS outliers
               FROM fenced GROUP BY readmitted, n, q1, median, q3""",
        ),
        "age_rate_panel": _with(
            _CLEAN,
            """SELECT CAST(d.decade AS INT) AS band_order, d.band AS age_group,
                 replace(replace(d.band, '[', ''), ')', '') AS label,
                 AVG(c.readmitted_30d) AS rate, NULLIF(COUNT(c.encounter_id), 0) AS encounters,
                 CAST(COALESCE(AVG(c.readmitted_30d) > 0.12, FALSE) AS INT) AS above_alert,
                 (SELECT AVG(readmitted_30d) FROM clean) AS overall_rate
               FROM decades d LEFT JOIN clean c ON c.age_group = d.band
               GROUP BY d.decade, d.band""",
        ),
        "medication_curve": _with(
            _CLEAN + f",\nbins(bin_order, low, high, label) AS (VALUES {bins})",
            f"""SELECT CAST(b.bin_order AS INT) AS bin_order, b.label AS medication_bin,
                  {_pct('SUM(c.readmitted_30d)', 'COUNT(c.encounter_id)')} AS readmission_rate_pct
                FROM bins b
                LEFT JOIN clean c ON c.num_medications > b.low AND c.num_medications <= b.high
                GROUP BY b.bin_order, b.label""",
        ),
    }


def _cohorts() -> dict:
    pairs = " UNION ALL ".join(
        f"SELECT '{CORRELATED_COLUMNS[i]}' AS x, '{CORRELATED_COLUMNS[j]}' AS y, "
        f"ROUND(CORR({CORRELATED_COLUMNS[i]}, {CORRELATED_COLUMNS[j]}), 6) AS corr FROM clean"
        for i in range(len(CORRELATED_COLUMNS))
        for j in range(i)
    )
    dimensions = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS cohort, readmitted FROM encounters"
        for d in ("primary_diagnosis", "age_group", "discharge_disposition")
    )
    high, moderate, low = RISK_FLAGS
    high_level, moderate_level, low_level = RISK_LEVELS
    return {
        "diagnosis_risk_top20": _with(
            _ENCOUNTERS,
            f"""SELECT primary_diagnosis, COUNT(*) AS total_cases, {_R30} AS readmissions_30d,
                  {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_pct,
                  {_mean2('time_in_hospital')} AS avg_los, {_mean2('num_medications')} AS avg_medications,
                  CASE WHEN 100 * {_R30} >= 20 * COUNT(*) THEN '{high}'
                       WHEN 100 * {_R30} >= 12 * COUNT(*) THEN '{moderate}' ELSE '{low}' END AS risk_flag
                FROM encounters GROUP BY primary_diagnosis HAVING COUNT(*) >= 100
                ORDER BY readmission_rate_pct DESC, primary_diagnosis LIMIT 20""",
        ),
        "diagnosis_risk_top10": _with(
            _CLEAN,
            f"""SELECT primary_diagnosis, COUNT(*) AS total,
                  CAST(SUM(readmitted_30d) AS BIGINT) AS readmissions,
                  AVG(time_in_hospital) AS avg_los, AVG(num_medications) AS avg_meds,
                  AVG(readmitted_30d) AS readmission_rate,
                  CASE WHEN 100 * SUM(readmitted_30d) >= 20 * COUNT(*) THEN '{high_level}'
                       WHEN 100 * SUM(readmitted_30d) >= 12 * COUNT(*) THEN '{moderate_level}'
                       ELSE '{low_level}' END AS risk_level
                FROM clean WHERE primary_diagnosis IS NOT NULL
                GROUP BY primary_diagnosis HAVING COUNT(*) >= 100
                ORDER BY readmission_rate DESC, primary_diagnosis LIMIT 10""",
        ),
        "service_opportunities": _with(
            _ENCOUNTERS
            + f""",
cohorts AS (
  SELECT dimension, cohort, COUNT(*) AS n, {_R30} AS hits
  FROM ({dimensions}) WHERE cohort IS NOT NULL GROUP BY dimension, cohort
  HAVING dimension <> 'primary_diagnosis' OR COUNT(*) >= 100
)""",
            f"""SELECT dimension,
                  CAST(RANK() OVER (PARTITION BY dimension ORDER BY {_pct('hits', 'n')} DESC) AS INT)
                    AS opportunity_rank,
                  cohort, n AS total_cases, hits AS readmissions_30d,
                  {_pct2('hits', 'n')} AS readmission_rate_pct,
                  CAST(100 * hits >= 15 * n AS INT) AS intervention_flag
                FROM cohorts""",
        ),
        "age_cohort_rank": _with(
            _ENCOUNTERS,
            f"""SELECT age_group, COUNT(*) AS total_patients,
                  {_mean2('time_in_hospital')} AS avg_los, {_mean2('num_medications')} AS avg_medications,
                  {_mean2('num_lab_procedures')} AS avg_lab_procedures, {_R30} AS readmissions_30d,
                  {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_pct,
                  CAST(RANK() OVER (ORDER BY {_pct(_R30, 'COUNT(*)')} DESC) AS INT) AS risk_rank
                FROM encounters GROUP BY age_group""",
        ),
        "correlation_pairs": _with(_CLEAN, pairs),
        "medication_tiers": _with(
            _ENCOUNTERS
            + """,
tiered AS (
  SELECT *, CASE WHEN num_medications < 5 THEN '1-4 medications' WHEN num_medications < 10 THEN '5-9 medications'
                 WHEN num_medications < 15 THEN '10-14 medications' WHEN num_medications < 20 THEN '15-19 medications'
                 ELSE '20+ medications' END AS medication_tier
  FROM encounters
)""",
            f"""SELECT medication_tier, COUNT(*) AS patient_count, {_mean2('time_in_hospital')} AS avg_los,
                  {_mean2('num_diagnoses')} AS avg_diagnoses, {_R30} AS readmissions_30d,
                  {_pct2(_R30, 'COUNT(*)')} AS readmission_rate_pct
                FROM tiered GROUP BY medication_tier""",
        ),
        "disposition_impact": _with(
            _ENCOUNTERS
            + f""",
grouped AS (
  SELECT e.discharge_disposition, COUNT(*) AS n, {_R30} AS hits, {_mean2('time_in_hospital')} AS avg_los
  FROM encounters e LEFT JOIN nation k ON k.n_nationkey = e.discharge_disposition_id
  GROUP BY e.discharge_disposition
)""",
            f"""SELECT discharge_disposition, n AS total_discharges, hits AS readmissions_30d,
                  {_pct2('hits', 'n')} AS readmission_rate_pct, avg_los,
                  CAST(SUM(n) OVER (ORDER BY {_pct('hits', 'n')} DESC, discharge_disposition
                    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_discharges
                FROM grouped""",
        ),
        "specialty_source_benchmark": _with(
            _ENCOUNTERS
            + f""",
grouped AS (
  SELECT e.medical_specialty, e.admission_source, COUNT(DISTINCT e.patient_id) AS unique_patients,
         COUNT(*) AS n, {_mean2('time_in_hospital')} AS avg_los, {_R30} AS hits
  FROM encounters e
  LEFT JOIN region r ON r.r_regionkey = e.medical_specialty_id
  LEFT JOIN nation k ON k.n_nationkey = e.admission_source_id
  WHERE e.medical_specialty IS NOT NULL
  GROUP BY e.medical_specialty, e.admission_source HAVING COUNT(*) >= 50
),
benchmark AS (SELECT AVG({_pct('hits', 'n')}) AS mean_rate FROM grouped)""",
            f"""SELECT medical_specialty, admission_source, unique_patients, n AS encounters, avg_los,
                  hits AS readmissions_30d, {_pct2('hits', 'n')} AS readmission_rate_pct,
                  ROUND(mean_rate, 2) AS overall_avg_rate,
                  ROUND({_pct('hits', 'n')} - mean_rate, 2) AS variance_from_benchmark
                FROM grouped, benchmark""",
        ),
    }


def _contract() -> dict:
    meets, near, exceeds = MONTH_STATUS
    met, missed = PERIOD_STATUS

    def rate_where(condition):
        return _pct(
            f"SUM(readmitted_30d) FILTER (WHERE {condition})", f"COUNT(*) FILTER (WHERE {condition})"
        )

    return {
        "monthly_scorecard": _with(
            _ENCOUNTERS
            + f""",
months AS (
  SELECT CAST(DATE_TRUNC('month', admission_date) AS TIMESTAMP) AS report_month, COUNT(*) AS n,
         {_R30} AS hits, {_mean2('time_in_hospital')} AS avg_los,
         {_mean2('num_medications')} AS avg_medications, COUNT(DISTINCT patient_id) AS unique_patients
  FROM encounters GROUP BY 1
),
numbered AS (
  SELECT *, {_pct('hits', 'n')} AS rate, ROW_NUMBER() OVER (ORDER BY report_month) AS pos FROM months
)""",
            f"""SELECT m.report_month, m.n AS total_admissions, m.hits AS readmissions_30d,
                  {_pct2('m.hits', 'm.n')} AS readmission_rate_pct, m.avg_los, m.avg_medications,
                  m.unique_patients, p.rate AS prev_month_rate,
                  ROUND(m.rate - p.rate, 2) AS rate_change_mom,
                  ROUND((SELECT AVG(x.rate) FROM numbered x WHERE x.pos BETWEEN m.pos - 2 AND m.pos), 2)
                    AS rolling_3mo_avg,
                  CASE WHEN 100 * m.hits <= 11 * m.n THEN '{meets}'
                       WHEN 100 * m.hits <= 13 * m.n THEN '{near}' ELSE '{exceeds}' END AS performance_status
                FROM numbered m LEFT JOIN numbered p ON p.pos = m.pos - 1""",
        ),
        "period_guarantee": _with(
            _CLEAN,
            f"""SELECT 'all admissions' AS period,
                  {_pct('SUM(readmitted_30d)', 'COUNT(*)')} AS readmission_rate_30day_pct,
                  CAST(11 AS DOUBLE) AS target_rate_pct,
                  CASE WHEN 100 * SUM(readmitted_30d) <= 11 * COUNT(*) THEN '{met}' ELSE '{missed}' END AS status,
                  {_pct('SUM(readmitted_any)', 'COUNT(*)')} AS readmission_rate_any_pct,
                  AVG(time_in_hospital) AS avg_length_of_stay, AVG(num_medications) AS avg_medications
                FROM clean""",
        ),
        "quarter_guarantee": _with(
            _ENCOUNTERS,
            f"""SELECT 'Q2 1996' AS period,
                  {_pct(_R30, 'COUNT(*)')} AS readmission_rate_30day_pct,
                  CAST(11 AS DOUBLE) AS target_rate_pct,
                  CASE WHEN 100 * {_R30} <= 11 * COUNT(*) THEN '{met}' ELSE '{missed}' END AS status,
                  {_pct("COUNT(*) FILTER (WHERE readmitted IS DISTINCT FROM 'NO')", 'COUNT(*)')} AS readmission_rate_any_pct,
                  AVG(time_in_hospital) AS avg_length_of_stay, AVG(num_medications) AS avg_medications
                FROM encounters WHERE admission_date >= DATE '1996-04-01' AND admission_date < DATE '1996-07-01'""",
        ),
        "polypharmacy_ratio": _with(
            _CLEAN,
            f"""SELECT COUNT(*) FILTER (WHERE num_medications >= 20) AS polypharmacy_encounters,
                  COUNT(*) FILTER (WHERE num_medications < 20) AS other_encounters,
                  {rate_where('num_medications >= 20')} AS polypharmacy_rate_pct,
                  {rate_where('num_medications < 20')} AS other_rate_pct,
                  ({rate_where('num_medications >= 20')}) / ({rate_where('num_medications < 20')}) AS rate_ratio
                FROM clean""",
        ),
        "top5_diagnosis_share": _with(
            _CLEAN
            + """,
front_runners AS (
  SELECT SUM(readmitted_30d) AS hits FROM clean WHERE primary_diagnosis IS NOT NULL
  GROUP BY primary_diagnosis ORDER BY hits DESC, primary_diagnosis LIMIT 5
),
summed AS (
  SELECT (SELECT SUM(hits) FROM front_runners) AS top, (SELECT SUM(readmitted_30d) FROM clean) AS everything
)""",
            f"""SELECT CAST(top AS BIGINT) AS top_readmissions,
                  CAST(everything AS BIGINT) AS total_readmissions,
                  {_pct('top', 'everything')} AS share_pct FROM summed""",
        ),
        "disposition_ratio": _with(
            _ENCOUNTERS
            + f""",
rates AS (
  SELECT discharge_disposition AS d, {_pct(_R30, 'COUNT(*)')} AS rate FROM encounters
  GROUP BY discharge_disposition
)""",
            """SELECT a.d AS disposition, a.rate AS rate_pct, b.d AS compared_with,
                 b.rate AS compared_rate_pct, a.rate / b.rate AS rate_ratio
               FROM rates a, rates b WHERE a.d = 'O' AND b.d = 'F'""",
        ),
        "leading_age_bands": _with(
            _CLEAN,
            f"""SELECT age_group, readmission_rate_pct, CAST(place AS INT) AS risk_rank
                FROM (SELECT *, RANK() OVER (ORDER BY readmission_rate_pct DESC) AS place
                      FROM (SELECT age_group, {_pct('SUM(readmitted_30d)', 'COUNT(*)')}
                              AS readmission_rate_pct FROM clean GROUP BY age_group))
                WHERE place <= 2""",
        ),
    }


# --- Risk model -----------------------------------------------------------------

_MODEL_ROWS = (
    _CLEAN
    + f""",
model_rows AS (
  SELECT encounter_id, patient_id, {', '.join(MODEL_FEATURES)}, readmitted_30d FROM clean
  WHERE {' AND '.join(f'{name} IS NOT NULL' for name in MODEL_FEATURES)}
)"""
)

_SPLIT = (
    _MODEL_ROWS
    + """,
mixed AS (
  SELECT *, ((low * 48271 + high * 69621 + 42) % 2147483647 * 1664525) % 4294967296 * 2147483648
         + (low * 16807 + high * 40692 + 42) % 2147483647 AS h
  FROM (SELECT *, encounter_id % 2147483647 AS low, encounter_id // 2147483647 % 2147483647 AS high
        FROM model_rows)
),
label_sizes AS (
  SELECT readmitted_30d AS label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total
  FROM model_rows GROUP BY readmitted_30d
),
train_parts AS (
  SELECT *, (n * (total - (total + 4) // 5)) // total AS whole,
         (n * (total - (total + 4) // 5)) % total AS remainder FROM label_sizes
),
quotas AS (
  SELECT label, n - whole - CASE WHEN ROW_NUMBER() OVER (ORDER BY remainder DESC, label)
           <= (total - (total + 4) // 5) - SUM(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM train_parts
),
split AS (
  SELECT m.*, CAST(RANK() OVER (PARTITION BY m.readmitted_30d ORDER BY m.h) <= q.quota AS INT) AS is_test
  FROM mixed m JOIN quotas q ON q.label = m.readmitted_30d
),
scaling AS MATERIALIZED (
  SELECT """
    + ", ".join(
        f"AVG({name}) AS mean_{name}, COALESCE(NULLIF(STDDEV_POP({name}), 0), 1) AS scale_{name}"
        for name in MODEL_FEATURES
    )
    + """, COUNT(*) AS train_rows FROM split WHERE is_test = 0
)"""
)

# Newton's method on the penalized likelihood, one elimination per step. It
# converges quadratically, so twelve steps are at rounding error.
_NEWTON_STEPS = 12


def _newton() -> str:
    size = len(MODEL_FEATURES) + 1
    vector = ", ".join(
        ["1.0::DOUBLE"] + [f"(s.{n} - c.mean_{n}) / c.scale_{n}" for n in MODEL_FEATURES]
    )
    parts = [
        _SPLIT,
        f"""vectors AS MATERIALIZED (
  SELECT s.encounter_id, s.patient_id, s.is_test, s.readmitted_30d AS y, [{vector}] AS z
  FROM split s, scaling c
)""",
        f"fit0 AS MATERIALIZED (SELECT [{', '.join(['0.0::DOUBLE'] * size)}] AS b)",
    ]
    for step in range(_NEWTON_STEPS):
        sums = [
            f"SUM(w * z[{i}] * z[{j}]) AS h{i}_{j}"
            for i in range(1, size + 1)
            for j in range(i, size + 1)
        ] + [f"SUM(z[{i}] * (y - p)) AS g{i}" for i in range(1, size + 1)]
        rows = []
        for i in range(1, size + 1):
            cells = [
                f"h{min(i, j)}_{max(i, j)}" + (" + 1" if i == j and i > 1 else "")
                for j in range(1, size + 1)
            ]
            cells.append(f"g{i}" + (f" - b[{i}]" if i > 1 else ""))
            rows.append(f"[{', '.join(cells)}]")
        parts.append(
            f"""sums{step} AS MATERIALIZED (
  SELECT ANY_VALUE(b) AS b, {', '.join(sums)}
  FROM (SELECT *, p * (1 - p) AS w FROM (
    SELECT v.z, v.y, f.b, 1 / (1 + EXP(-LIST_INNER_PRODUCT(v.z, f.b))) AS p
    FROM vectors v, fit{step} f WHERE v.is_test = 0))
)"""
        )
        parts.append(
            f"m{step}_0 AS MATERIALIZED (SELECT b, [{', '.join(rows)}] AS m FROM sums{step})"
        )
        for p in range(1, size + 1):
            parts.append(
                f"""m{step}_{p} AS MATERIALIZED (
  SELECT b, LIST_TRANSFORM(m, LAMBDA r, i: LIST_TRANSFORM(r, LAMBDA x, j:
    CASE WHEN i = {p} THEN x / m[{p}][{p}] ELSE x - r[{p}] * m[{p}][j] / m[{p}][{p}] END)) AS m
  FROM m{step}_{p - 1}
)"""
            )
        parts.append(
            f"""fit{step + 1} AS MATERIALIZED (
  SELECT LIST_TRANSFORM(b, LAMBDA x, i: x + m[i][{size + 1}]) AS b FROM m{step}_{size}
)"""
        )
    names = ", ".join(f"({i + 2}, '{name}')" for i, name in enumerate(MODEL_FEATURES))
    parts.append(
        f"""effects AS (
  SELECT n.feature, f.b[n.i] AS coefficient
  FROM fit{_NEWTON_STEPS} f, (VALUES {names}) n(i, feature)
)"""
    )
    parts.append(
        f"""scored AS MATERIALIZED (
  SELECT v.encounter_id, v.patient_id, v.is_test, v.y,
         1 / (1 + EXP(-LIST_INNER_PRODUCT(v.z, f.b))) AS p
  FROM vectors v, fit{_NEWTON_STEPS} f
)"""
    )
    return ",\n".join(parts)


def _model() -> dict:
    newton = _newton()
    scale = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, ROUND(mean_{n}, 6) AS mean, ROUND(scale_{n}, 6) AS scale, train_rows FROM scaling"
        for n in MODEL_FEATURES
    )
    ratio = "CAST(({s} * CAST({a} AS BIGINT) * 2 + {b}) // (2 * NULLIF({b}, 0)) AS DOUBLE) / {s}"
    # HMAC-SHA256 under the fixture's key, which is not a secret.
    inner, outer = (bytes(b ^ pad for b in b"fixture".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    digest = f"SHA256(UNHEX('{inner}') || ENCODE(CAST(patient_id AS VARCHAR)))"
    token = f"SHA256(UNHEX('{outer}') || UNHEX({digest})) AS patient_token"
    report = """,
cells AS (
  SELECT COUNT(*) FILTER (WHERE y = 0) AS s0, COUNT(*) FILTER (WHERE y = 1) AS s1,
         COUNT(*) FILTER (WHERE p <= 0.5) AS c0, COUNT(*) FILTER (WHERE p > 0.5) AS c1,
         COUNT(*) FILTER (WHERE y = 0 AND p <= 0.5) AS t0, COUNT(*) FILTER (WHERE y = 1 AND p > 0.5) AS t1
  FROM scored WHERE is_test = 1
),
per_class AS (
  SELECT 'No Readmit' AS row, COALESCE(CAST(t0 AS DOUBLE) / NULLIF(c0, 0), 0) AS precision,
         COALESCE(CAST(t0 AS DOUBLE) / NULLIF(s0, 0), 0) AS recall, s0 AS support FROM cells
  UNION ALL
  SELECT 'Readmitted <30d', COALESCE(CAST(t1 AS DOUBLE) / NULLIF(c1, 0), 0),
         COALESCE(CAST(t1 AS DOUBLE) / NULLIF(s1, 0), 0), s1 FROM cells
),
rated AS (
  SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0) AS f1_score FROM per_class
)"""
    return {
        "model_features": _with(
            _ENCOUNTERS,
            f"""SELECT patient_id, encounter_id, age_numeric, time_in_hospital, num_lab_procedures,
                  num_procedures, num_medications, num_diagnoses,
                  {ratio.format(a='num_lab_procedures', b='time_in_hospital', s=100)} AS labs_per_day,
                  {ratio.format(a='num_medications', b='num_diagnoses', s=100)} AS meds_per_diagnosis,
                  CAST(gender = 'Female' AS INT) AS is_female,
                  CAST(a1c_result IN ('Norm', '>7', '>8') AS INT) AS has_a1c_result,
                  CAST(change = 'Ch' AS INT) AS medication_changed,
                  CAST(diabetesMed = 'Yes' AS INT) AS on_diabetes_med,
                  CAST(num_diagnoses >= 5 AS INT) AS complex_patient,
                  CAST(num_medications >= 15 AS INT) AS polypharmacy_flag,
                  CAST(readmitted = '<30' AS INT) AS readmitted_30d
                FROM encounters""",
        ),
        "model_frame": _with(_MODEL_ROWS, "SELECT * FROM model_rows"),
        "split_strata": _with(_SPLIT, "SELECT encounter_id, readmitted_30d, is_test FROM split"),
        "scaler_stats": _with(_SPLIT, scale),
        "lr_coefficients": _with(
            newton,
            """SELECT feature, ROUND(coefficient, 6) AS coefficient, ROUND(ABS(coefficient), 6) AS abs_coef
               FROM effects""",
        ),
        "risk_scores": _with(
            newton,
            f"""SELECT {token}, encounter_id, ROUND(p, 6) AS risk_probability,
                  CAST(p > 0.5 AS INT) AS predicted_readmit FROM scored""",
        ),
        "patient_risk": _with(
            newton,
            f"""SELECT {token}, COUNT(*) AS encounters, ROUND(MAX(p), 6) AS risk_probability
                FROM scored GROUP BY patient_id""",
        ),
        # The area under the curve as the chance that a readmitted encounter
        # outranks another one, ties counting half.
        "model_metrics": _with(
            newton
            + """,
ranked AS (
  SELECT y, p, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS place
  FROM scored WHERE is_test = 1
)""",
            """SELECT ROUND((SUM(place) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0)
                   / (SUM(y) * (COUNT(*) - SUM(y))), 6) AS roc_auc,
                 COUNT(*) AS test_records,
                 CAST(COUNT(*) FILTER (WHERE (p > 0.5) = (y = 1)) AS DOUBLE) / COUNT(*) AS accuracy
               FROM ranked""",
        ),
        "classification_report": _with(
            newton + report,
            """SELECT row, precision, recall, f1_score, support FROM rated
               UNION ALL
               SELECT 'accuracy', NULL, NULL, CAST(t0 + t1 AS DOUBLE) / (s0 + s1), s0 + s1 FROM cells
               UNION ALL
               SELECT 'macro avg', SUM(precision) / 2, SUM(recall) / 2, SUM(f1_score) / 2,
                 CAST(SUM(support) AS BIGINT) FROM rated
               UNION ALL
               SELECT 'weighted avg', SUM(precision * support) / SUM(support),
                 SUM(recall * support) / SUM(support), SUM(f1_score * support) / SUM(support),
                 CAST(SUM(support) AS BIGINT) FROM rated""",
        ),
        "risk_drivers": _with(
            newton,
            """SELECT effect, CAST(place AS INT) AS effect_rank, feature, ROUND(coefficient, 6) AS coefficient
               FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY effect ORDER BY ABS(coefficient) DESC, feature)
                       AS place
                     FROM (SELECT *, CASE WHEN coefficient > 0 THEN 'risk' ELSE 'protective' END AS effect
                           FROM effects WHERE coefficient <> 0))
               WHERE place <= 3""",
        ),
    }


def oracle_statements() -> dict[str, str]:
    found = {**_quality(), **_descriptive(), **_cohorts(), **_contract(), **_model()}
    # Kept up to date in other ways, with the same rows.
    return found | {
        "dq_scorecard_stored": found["dq_scorecard"],
        "monthly_refresh": found["monthly_scorecard"],
        "warehouse_run": found["kpi_summary"],
    }
