"""Labels, bands and thresholds that reports must show exactly.

Nothing in here is computed. Thresholds are the defaults of the operators that
take them as arguments.
"""

from decimal import Decimal

# Outcome codes of an encounter.
READMITTED_WITHIN_30 = "<30"
READMITTED_AFTER_30 = ">30"
NOT_READMITTED = "NO"

# Marker the raw extract uses for a missing value.
MISSING_MARKER = "?"

# Ten-year age bands and the midpoint that stands for each.
AGE_BANDS = (
    ("[0-10)", 5),
    ("[10-20)", 15),
    ("[20-30)", 25),
    ("[30-40)", 35),
    ("[40-50)", 45),
    ("[50-60)", 55),
    ("[60-70)", 65),
    ("[70-80)", 75),
    ("[80-90)", 85),
    ("[90-100)", 95),
)

# Plausible ages, both ends included.
AGE_MIN, AGE_MAX = 0, 120

# Flags of the encounter vocabulary.
MEDICATION_CHANGED = "Ch"
ON_DIABETES_MEDICATION = "Yes"
FEMALE = "Female"
A1C_MEASURED = ("Norm", ">7", ">8")
A1C_NOT_MEASURED = "None"
COMPLEX_DIAGNOSES = 5
POLYPHARMACY_MEDICATIONS = 15

# Medication tiers of the cohort report: upper bound (excluded) and label. The
# rest, which includes encounters whose count is unknown, is the last tier.
MEDICATION_TIERS = (
    (5, "1-4 medications"),
    (10, "5-9 medications"),
    (15, "10-14 medications"),
    (20, "15-19 medications"),
)
MEDICATION_TIER_REST = "20+ medications"

# Medication bins of the dashboard curve: (low, high] and label.
MEDICATION_BINS = (
    (0, 5, "1-5"),
    (5, 10, "6-10"),
    (10, 15, "11-15"),
    (15, 20, "16-20"),
    (20, 100, "20+"),
)

# Outcome groups of the length-of-stay box plot.
BOX_GROUPS = (
    (NOT_READMITTED, "No Readmit"),
    (READMITTED_AFTER_30, ">30 Days"),
    (READMITTED_WITHIN_30, "<30 Days"),
)

# Diagnosis risk levels, cut at a 30-day rate in percent.
RISK_CUTS_PCT = (20, 12)
RISK_FLAGS = (
    "HIGH RISK — intervention needed",
    "MODERATE RISK — monitor closely",
    "LOW RISK — standard care",
)
RISK_LEVELS = ("🔴 HIGH", "🟡 MOD", "🟢 LOW")
AGE_RATE_ALERT = 0.12
OPPORTUNITY_RATE_PCT = 15.0

# Smallest cohorts worth reporting.
MIN_DIAGNOSIS_CASES = 100
MIN_BENCHMARK_ENCOUNTERS = 50

# Contract: target and near-miss limit of the 30-day rate, in percent.
TARGET_RATE_PCT = 11.0
NEAR_TARGET_RATE_PCT = 13.0
MONTH_STATUS = ("MEETS TARGET ✓", "NEAR THRESHOLD ⚠", "EXCEEDS TARGET ✗")
PERIOD_STATUS = ("✓ MEETS TARGET", "✗ EXCEEDS TARGET")

# Names of the headline figures.
KPI_NAMES = (
    "Total Encounters",
    "Unique Patients",
    "Avg Length of Stay (days)",
    "Avg Medications",
    "Avg Lab Procedures",
    "30-Day Readmission Rate",
    "Any Readmission Rate",
)

# Columns without which an encounter is not analysed.
CRITICAL_COLUMNS = ("age_numeric", "time_in_hospital", "num_medications")

# Columns of the correlation table.
CORRELATED_COLUMNS = (
    "age_numeric",
    "time_in_hospital",
    "num_lab_procedures",
    "num_procedures",
    "num_medications",
    "num_diagnoses",
    "readmitted_30d",
    "labs_per_day",
    "polypharmacy_flag",
)

# Inputs and target of the risk model.
MODEL_FEATURES = (
    "age_numeric",
    "time_in_hospital",
    "num_lab_procedures",
    "num_procedures",
    "num_medications",
    "num_diagnoses",
    "medication_changed",
    "on_diabetes_med",
    "has_a1c_result",
    "labs_per_day",
    "meds_per_diagnosis",
    "polypharmacy_flag",
    "complex_patient",
)
MODEL_TARGET = "readmitted_30d"
TEST_SHARE = Decimal("0.2")
SPLIT_SEED = 42
MAX_ITERATIONS = 1000
INVERSE_PENALTY = 1.0
CLASS_NAMES = ("No Readmit", "Readmitted <30d")
