import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.fixed_values import CLASS_NAMES, MODEL_FEATURES
from wardlight.functions import privacy
from wardlight.operators import features, model


@pytest.fixture(scope="module")
def synthetic(spark):
    """Rows whose outcome depends on some features, one of them constant."""
    rng = np.random.default_rng(11)
    rows = []
    for number in range(1, 1501):
        x = [float(v) for v in rng.normal(20, 6, len(MODEL_FEATURES))]
        x[10] = 3.0
        risk = -1.0 + 0.12 * (x[0] - 20) - 0.2 * (x[4] - 20)
        label = int(rng.random() < 1 / (1 + math.exp(-risk)))
        rows.append((number, number % 300, *x, label))
    columns = ", ".join(f"{name} double" for name in MODEL_FEATURES)
    return spark.createDataFrame(
        rows, f"encounter_id bigint, patient_id bigint, {columns}, readmitted_30d int"
    )


@pytest.fixture(scope="module")
def split(spark, synthetic, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("split"))
    features.stratified_split(synthetic).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fitted(split):
    return model.fit_risk_model(split)


def _arrays(frame):
    rows = frame.orderBy("encounter_id").collect()
    x = np.array([[row[name] for name in MODEL_FEATURES] for row in rows])
    return x, np.array([row["readmitted_30d"] for row in rows])


def _newton(z, y, penalty=1.0):
    z = np.column_stack([np.ones(len(z)), z])
    weights = np.zeros(z.shape[1])
    ridge = np.diag([0.0] + [penalty] * (z.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ weights))
        weights = weights + np.linalg.solve(
            (z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ weights
        )
    return weights


def test_split_takes_exact_quotas_by_smallest_hash(split):
    rows = split.withColumn("h", features.split_hash(F.col("encounter_id"))).collect()
    sizes = {label: sum(r["readmitted_30d"] == label for r in rows) for label in (0, 1)}
    n_test = math.ceil(0.2 * len(rows))
    assert sum(row["is_test"] for row in rows) == n_test
    for label in (0, 1):
        ordered = sorted((r for r in rows if r["readmitted_30d"] == label), key=lambda r: r["h"])
        taken = sum(row["is_test"] for row in ordered)
        assert abs(taken - 0.2 * sizes[label]) < 1
        assert [row["is_test"] for row in ordered] == [1] * taken + [0] * (len(ordered) - taken)


def test_split_does_not_depend_on_partitioning(synthetic, split):
    other = features.stratified_split(synthetic.repartition(7))
    chosen = {row["encounter_id"] for row in other.where("is_test = 1").collect()}
    assert chosen == {row["encounter_id"] for row in split.where("is_test = 1").collect()}


def test_another_seed_gives_another_split(synthetic, split):
    other = features.stratified_split(synthetic, seed=7)
    chosen = {row["encounter_id"] for row in other.where("is_test = 1").collect()}
    assert chosen != {row["encounter_id"] for row in split.where("is_test = 1").collect()}


def test_copies_of_an_encounter_stay_together(spark):
    rows = [(number, number % 2) for number in range(100)] + [(3, 1)] * 50
    frame = spark.createDataFrame(rows, "encounter_id bigint, readmitted_30d int")
    sides = features.stratified_split(frame).groupBy("encounter_id").agg(
        F.countDistinct("is_test").alias("sides")
    )
    assert sides.where("sides > 1").count() == 0


@pytest.mark.parametrize(
    "sizes, quotas",
    [
        ({0: 80, 1: 20}, {0: 16, 1: 4}),
        ({0: 7, 1: 4}, {0: 2, 1: 1}),
        ({0: 1}, {0: 1}),
        ({}, {}),
        ({0: 999_999_999_999, 1: 1}, {0: 200_000_000_000}),
    ],
)
def test_quotas(sizes, quotas):
    assert features._test_quotas(sizes, "0.2") == quotas


def test_hash_covers_every_number(spark):
    numbers = [(0,), (1,), (-1,), (2**63 - 1,), (-(2**63),)]
    wide = spark.createDataFrame(numbers, "encounter_id bigint")
    narrow = spark.createDataFrame([(2**31 - 1,)], "encounter_id int")
    for frame in (wide, narrow):
        for row in frame.select(features.split_hash(F.col("encounter_id")).alias("h")).collect():
            assert 0 <= row["h"] < 2**63


def test_hash_tells_apart_numbers_beyond_the_prime(spark):
    apart = (1, 1 + 2147483647, 1 + 2 * 2147483647, -1, 2147483646)
    frame = spark.createDataFrame([(n,) for n in apart], "encounter_id bigint")
    hashes = frame.select(features.split_hash(F.col("encounter_id")).alias("h")).distinct()
    assert hashes.count() == len(apart)


def test_split_of_nothing(synthetic):
    assert features.stratified_split(synthetic.limit(0)).count() == 0


def test_scaling_uses_the_training_side_and_population_deviation(split):
    x, _ = _arrays(split.where("is_test = 0"))
    stats = {row["feature"]: row for row in features.scaler_stats(split).collect()}
    for place, name in enumerate(MODEL_FEATURES):
        assert stats[name]["mean"] == pytest.approx(x[:, place].mean())
        assert stats[name]["scale"] == pytest.approx(x[:, place].std() or 1.0)
    assert stats["age_numeric"]["train_rows"] == len(x)


def test_fit_is_the_penalized_optimum(split, fitted):
    x, y = _arrays(split.where("is_test = 0"))
    scale = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    weights = _newton((x - x.mean(axis=0)) / scale, y)
    assert fitted.intercept == pytest.approx(weights[0], abs=1e-10)
    assert np.allclose(fitted.coefficients, weights[1:], atol=1e-10)
    assert fitted.coefficients[10] == pytest.approx(0.0, abs=1e-10)


def test_fit_does_not_depend_on_partitioning(split, fitted):
    other = model.fit_risk_model(split.repartition(5))
    assert np.allclose(other.coefficients, fitted.coefficients, atol=1e-11)


def test_fit_reaches_the_optimum_despite_outliers(spark, split):
    # One value dwarfs the others of its column, and then decides its scale.
    wild = split.withColumn(
        "num_lab_procedures",
        F.when(F.col("encounter_id") % 500 == 1, 1e7).otherwise(F.col("num_lab_procedures")),
    ).withColumn(
        "labs_per_day",
        F.when(F.col("encounter_id") % 400 == 3, 1e6).otherwise(F.col("labs_per_day")),
    )
    x, y = _arrays(wild.where("is_test = 0"))
    scale = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    weights = _newton((x - x.mean(axis=0)) / scale, y)
    found = model.fit_risk_model(wild)
    assert np.allclose(found.coefficients, weights[1:], atol=1e-8)


def test_fit_needs_both_outcomes(split):
    with pytest.raises(ValueError, match="single outcome"):
        model.fit_risk_model(split.withColumn("readmitted_30d", F.lit(0)))


def test_fit_needs_rows(split):
    with pytest.raises(ValueError, match="training rows"):
        model.fit_risk_model(split.limit(0))


def test_area_under_the_curve_by_rank_sum(split, fitted):
    scored = model.score(fitted, split.where("is_test = 1"))
    rows = scored.select("risk_probability", "readmitted_30d").collect()
    positive = [row[0] for row in rows if row[1] == 1]
    negative = [row[0] for row in rows if row[1] == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    metrics = model.model_metrics(scored).first()
    assert metrics["roc_auc"] == pytest.approx(wins / len(positive) / len(negative), abs=1e-6)
    assert metrics["roc_auc"] > 0.6
    assert metrics["test_records"] == len(rows)


@pytest.mark.parametrize("partitions", [1, 7])
def test_area_with_tied_scores(spark, partitions):
    rng = np.random.default_rng(3)
    # A third of the rows share one score.
    rows = [
        (0.5 if i % 3 == 0 else float(rng.integers(1, 40)) / 40, int(rng.random() < 0.4), 0)
        for i in range(400)
    ]
    frame = spark.createDataFrame(
        rows, "risk_probability double, readmitted_30d int, predicted_readmit int"
    )
    positive = [score for score, label, _ in rows if label]
    negative = [score for score, label, _ in rows if not label]
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    metrics = model.model_metrics(frame.repartition(partitions)).first()
    assert metrics["roc_auc"] == round(wins / len(positive) / len(negative), 6)
    assert metrics["accuracy"] == len(negative) / 400


def test_area_of_more_pairs_than_a_long_counts(spark):
    # Weighted by repetition the old integer product passed 2**63; doubles do not.
    frame = spark.range(2).selectExpr(
        "id / 2D AS risk_probability", "cast(id AS int) AS readmitted_30d", "cast(id AS int) AS predicted_readmit"
    )
    assert model.model_metrics(frame.crossJoin(spark.range(50_000))).first()["roc_auc"] == 1.0


def test_fit_that_runs_out_of_steps_is_an_error(split):
    train = split.where("is_test = 0").selectExpr("cast(readmitted_30d AS double) AS y", "cast(age_numeric AS double) / 10 AS z1")
    with pytest.raises(model.NotConverged):
        model._newton(train, ["z1"], train.count(), 1.0, 1)


def test_a_step_of_the_fit_is_one_scan_and_one_small_matrix(spark):
    rows = spark.range(4000).selectExpr("cast(id % 3 = 0 AS double) AS y", "id % 7 / 7D AS z1", "id % 11 / 11D - z1 AS z2")
    weights = np.array([0.2, -1.5, 0.7])
    spark.sparkContext.setJobGroup("step", "")
    loss, gradient, curvature = model._loss_terms(rows, ["z1", "z2"], weights, 0.5)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("step"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    x = np.array([[1.0, r["z1"], r["z2"]] for r in rows.collect()])
    y = np.array([r["y"] for r in rows.collect()])
    m = x @ weights
    p = 1 / (1 + np.exp(-m))
    ridge = np.array([0.0, 0.5, 0.5])
    assert loss == pytest.approx((np.log1p(np.exp(m)) - y * m).sum() + 0.5 * ridge @ weights**2, rel=1e-12)
    assert gradient == pytest.approx(x.T @ (y - p) - ridge * weights, rel=1e-9)
    assert curvature == pytest.approx((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), rel=1e-9)
    assert jobs <= 2  # the first row for its length, then the sums


def test_outcomes_that_the_features_nearly_separate(spark):
    """Probabilities next to 0 and 1 leave the fit finite and at its optimum."""
    rows = [(float(i > 50), float(i) * (1000 if i == 99 else 1), 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "readmitted_30d double, f double, is_test int")
    fitted = model.fit_risk_model(frame, features=("f",), inverse_penalty=1e6, max_iterations=60)
    z = np.array([(r[1] - fitted.means[0]) / fitted.scales[0] for r in rows])
    p = 1 / (1 + np.exp(-(fitted.intercept + fitted.coefficients[0] * z)))
    y = np.array([r[0] for r in rows])
    assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * z).sum() - 1e-6 * fitted.coefficients[0]) < 1e-6


def test_metrics_without_both_outcomes_or_rows(spark):
    schema = "risk_probability double, readmitted_30d int, predicted_readmit int"
    one_class = model.model_metrics(spark.createDataFrame([(0.2, 0, 0)], schema)).first()
    assert tuple(one_class) == (None, 1, 1.0)
    assert tuple(model.model_metrics(spark.createDataFrame([], schema)).first()) == (None, 0, None)


def test_classification_report(spark):
    outcomes = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 0)] + [(1, 1)] * 3
    frame = spark.createDataFrame(outcomes, "readmitted_30d int, predicted_readmit int")
    report = {row["row"]: row for row in model.classification_report(frame).collect()}
    zero, one = (report[name] for name in CLASS_NAMES)
    assert (zero["precision"], zero["recall"], zero["support"]) == (6 / 7, 6 / 8, 8)
    assert (one["precision"], one["recall"], one["support"]) == (3 / 5, 3 / 4, 4)
    assert report["accuracy"]["f1_score"] == 9 / 12
    assert report["macro avg"]["recall"] == 0.75
    assert report["weighted avg"]["recall"] == pytest.approx(report["accuracy"]["f1_score"])


def test_report_of_a_class_never_predicted(spark):
    frame = spark.createDataFrame([(0, 0), (1, 0)], "readmitted_30d int, predicted_readmit int")
    report = {row["row"]: row for row in model.classification_report(frame).collect()}
    assert tuple(report[CLASS_NAMES[1]])[1:] == (0.0, 0.0, 0.0, 1)


def test_drivers_and_coefficients(spark):
    names = tuple("abcdefgh")
    weights = (0.5, -0.1, 0.0, 0.3, -0.9, 0.2, 0.1, -0.4)
    table = model.coefficients(model.RiskModel(names, (0.0,) * 8, (1.0,) * 8, weights, 0.0), spark)
    assert [row["feature"] for row in table.collect()][:2] == ["c", "b"]
    drivers = [(row["effect"], row["feature"]) for row in model.risk_drivers(table).collect()]
    assert drivers == [
        ("risk", "a"),
        ("risk", "d"),
        ("risk", "f"),
        ("protective", "e"),
        ("protective", "h"),
        ("protective", "b"),
    ]


def test_saved_model_scores_alike(spark, split, fitted, tmp_path):
    fitted.save(spark, str(tmp_path / "model"))
    loaded = model.RiskModel.load(spark, str(tmp_path / "model"))
    rows = model.score(fitted, split).exceptAll(model.score(loaded, split))
    assert rows.count() == 0


def test_scores_show_tokens_only(split, fitted):
    scored = model.score(fitted, split)
    scores = model.risk_scores(scored, "key")
    assert "patient_id" not in scores.columns
    first = scores.join(split.select("encounter_id", "patient_id"), "encounter_id").first()
    token = hmac.new(b"key", str(first["patient_id"]).encode(), hashlib.sha256).hexdigest()
    assert first["patient_token"] == token
    per_patient = model.patient_risk(scored, "key")
    assert per_patient.count() == 300
    best = scored.groupBy().max("risk_probability").first()[0]
    assert per_patient.agg(F.max("risk_probability")).first()[0] == pytest.approx(best, abs=1e-6)


def test_secret_is_in_no_plan_text(split, fitted):
    scored = model.score(fitted, split)
    secret = "do-not-print-this-secret"
    inner, outer = privacy._pads(secret)
    for report in (model.risk_scores(scored, secret), model.patient_risk(scored, secret)):
        report.count()
        text = report._jdf.queryExecution().toString()
        for key in (secret, inner.hex(), outer.hex(), inner.hex().upper(), str(list(inner))):
            assert key not in text
