"""The readmission risk model: distributed logistic regression and its reports."""

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wardlight.fixed_values import (
    CLASS_NAMES,
    INVERSE_PENALTY,
    MAX_ITERATIONS,
    MODEL_FEATURES,
    MODEL_TARGET,
)
from wardlight.functions.privacy import patient_token
from wardlight.operators.features import scaler_stats

# A Newton step this small leaves an error in the order of its square.
_REFINED = 1e-5

_MAX_HALVINGS = 30
_NO_GAIN = 1e-13
_LEAST_WEIGHT = 1e-24
_SCORE_BINS = 1 << 16

# Loss of a row with outcome y and linear predictor m, without overflow.
_ROW_LOSS = "greatest(m, 0D) + log1p(exp(-abs(m))) - y * m"


class NotConverged(Exception):
    """The fit ran out of steps before the optimum."""


@dataclass(frozen=True)
class RiskModel:
    """A fitted model: per feature its mean, scale and coefficient, and the intercept."""

    features: tuple
    means: tuple
    scales: tuple
    coefficients: tuple
    intercept: float

    def scaled(self) -> list:
        """The standardized features as SQL expressions."""
        return [
            f"((`{name}` - {mean!r}D) / {scale!r}D)"
            for name, mean, scale in zip(self.features, self.means, self.scales)
        ]

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the model as a small table, the intercept as a row without a feature."""
        rows = [
            *zip(self.features, self.means, self.scales, self.coefficients),
            (None, None, None, self.intercept),
        ]
        spark.createDataFrame(
            rows, "feature string, mean double, scale double, coefficient double"
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RiskModel":
        rows = spark.read.parquet(path).collect()
        effects = [row for row in rows if row["feature"] is not None]
        return cls(
            features=tuple(row["feature"] for row in effects),
            means=tuple(row["mean"] for row in effects),
            scales=tuple(row["scale"] for row in effects),
            coefficients=tuple(row["coefficient"] for row in effects),
            intercept=next(row["coefficient"] for row in rows if row["feature"] is None),
        )


def _linear(scaled: list, weights) -> str:
    """Intercept (first weight) plus weighted features, as a SQL expression."""
    intercept, *slopes = [float(weight) for weight in weights]
    terms = [f"{intercept!r}D", *[f"{x} * {slope!r}D" for x, slope in zip(scaled, slopes)]]
    return f"({' + '.join(terms)})"


def _logistic(linear: str) -> str:
    return f"1D / (1D + exp(-{linear}))"


def fit_risk_model(
    split: DataFrame,
    features: tuple = MODEL_FEATURES,
    target: str = MODEL_TARGET,
    inverse_penalty: float = INVERSE_PENALTY,
    max_iterations: int = MAX_ITERATIONS,
) -> RiskModel:
    """Fit on the training side of a split frame.

    The summed loss carries an L2 penalty of 1 / C for the `inverse_penalty` C, the intercept
    none. The features are standardized with the population deviation. The driver sees
    one row of scaling statistics and one small matrix per step. `split` is read twice, for
    the scaling and to keep the narrow scaled frame that all steps of the fit read.
    Raises NotConverged rather than returning weights short of the optimum.
    """
    stats = {row["feature"]: row for row in scaler_stats(split, features).collect()}
    train_rows = stats[features[0]]["train_rows"]
    if train_rows == 0:
        raise ValueError("no training rows with known features and target")
    unfitted = RiskModel(
        features=tuple(features),
        means=tuple(stats[name]["mean"] for name in features),
        scales=tuple(stats[name]["scale"] for name in features),
        coefficients=(0.0,) * len(features),
        intercept=0.0,
    )
    names = [f"z{i}" for i in range(1, len(features) + 1)]
    train = split.where(F.col("is_test") == 0).selectExpr(
        f"cast(`{target}` AS double) AS y",
        *[f"{expression} AS {name}" for expression, name in zip(unfitted.scaled(), names)],
    )
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights = _newton(train, names, train_rows, 1.0 / inverse_penalty, max_iterations)
    finally:
        train.unpersist()
    return RiskModel(
        features=unfitted.features,
        means=unfitted.means,
        scales=unfitted.scales,
        coefficients=tuple(float(weight) for weight in weights[1:]),
        intercept=float(weights[0]),
    )


def _newton(train: DataFrame, names: list, rows: int, penalty: float, max_steps: int) -> np.ndarray:
    """Newton steps from the weights that predict the share of readmissions for every row.

    The loss is convex and a step squares the distance that is left, so a handful is enough,
    and where it ends does not depend on how the rows are partitioned. Every step is one
    scan, which gives the loss, its gradient and its curvature at the weights tried. A step
    that does not lower the loss is halved until it does.
    """
    hits = train.agg(F.sum("y")).first()[0]
    if not 0 < hits < rows:
        raise ValueError("the training rows have a single outcome")
    weights = np.zeros(len(names) + 1)
    weights[0] = math.log(hits / (rows - hits))
    loss, gradient, curvature = _loss_terms(train, names, weights, penalty)
    for _ in range(max_steps):
        step = np.linalg.solve(curvature, gradient)
        # Half of this product is what the step should gain.
        if np.abs(step).max() < _REFINED or gradient @ step < _NO_GAIN * loss:
            return weights + step
        for halvings in range(_MAX_HALVINGS):
            tried = weights + step / 2**halvings
            terms = _loss_terms(train, names, tried, penalty)
            if terms[0] < loss:
                weights, (loss, gradient, curvature) = tried, terms
                break
        else:
            raise NotConverged("no step along the Newton direction lowers the loss")
    raise NotConverged(f"the fit has not converged after {max_steps} Newton steps")


def _loss_terms(train: DataFrame, names: list, weights: np.ndarray, penalty: float) -> tuple:
    """Penalized loss, its negative gradient and its curvature at the weights, from one scan.

    With the row vectors (w * x, (y - p) / w, sqrt(loss)) where w * w = p * (1 - p), the
    curvature is the Gramian of the first part, the gradient its products with the
    second, and the loss the square of the last. MLlib adds up the upper triangle of all
    products in blocks, in the JVM. Where w is next to nothing, a floor keeps the
    quotient finite; it cancels out of the gradient.
    """
    linear = _linear(names, weights)
    rated = train.selectExpr("*", f"{linear} AS m", f"{_logistic(linear)} AS p").selectExpr(
        "*", f"sqrt(greatest(p * (1 - p), {_LEAST_WEIGHT!r}D)) AS w"
    )
    parts = ["w", *[f"w * {name}" for name in names], "(y - p) / w", f"sqrt(greatest({_ROW_LOSS}, 0D))"]
    rows = rated.select(array_to_vector(F.array(*map(F.expr, parts))).alias("row"))
    gramian = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row")).computeGramianMatrix().toArray()
    size = len(names) + 1
    ridge = np.array([0.0] + [penalty] * (size - 1))
    loss = gramian[size + 1, size + 1] + 0.5 * float(ridge @ weights**2)
    gradient = gramian[:size, size] - ridge * weights
    return loss, gradient, gramian[:size, :size] + np.diag(ridge)


def score(model: RiskModel, frame: DataFrame) -> DataFrame:
    """The frame with `risk_probability` and the predicted class at 0.5.

    A plain expression over the feature columns, so scoring stays inside generated
    code and can follow any scan.
    """
    probability = _logistic(_linear(model.scaled(), [model.intercept, *model.coefficients]))
    return frame.withColumn("risk_probability", F.expr(probability)).withColumn(
        "predicted_readmit", (F.col("risk_probability") > 0.5).cast("int")
    )


def risk_scores(scored: DataFrame, secret: str) -> DataFrame:
    """Scores per encounter; the patient appears as a token only."""
    return scored.select(
        patient_token(F.col("patient_id"), secret).alias("patient_token"),
        "encounter_id",
        F.round("risk_probability", 6).alias("risk_probability"),
        "predicted_readmit",
    )


def patient_risk(scored: DataFrame, secret: str) -> DataFrame:
    """Highest score per patient. Combined map-side, before the tokens are made."""
    return (
        scored.where(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(
            F.count("*").alias("encounters"),
            F.round(F.max("risk_probability"), 6).alias("risk_probability"),
        )
        .select(
            patient_token(F.col("patient_id"), secret).alias("patient_token"),
            "encounters",
            "risk_probability",
        )
    )


def model_metrics(scored_test: DataFrame, target: str = MODEL_TARGET) -> DataFrame:
    """Exact ROC-AUC, accuracy and size of the test side.

    The area under every distinct score, ties counting half; NULL when the test side has a
    single outcome. Rows are counted by score first. A bin of scores then knows its share of
    pairs in the right order, and the bins, at most `_SCORE_BINS`, are put in order at the end.
    """
    known = scored_test.where(F.col(target).isin(0, 1) & F.col("risk_probability").isNotNull())
    by_score = known.groupBy("risk_probability").agg(
        F.count_if(F.col(target) == 1).cast("double").alias("hits"),
        F.count_if(F.col(target) == 0).cast("double").alias("others"),
        F.count_if(F.col("predicted_readmit") == F.col(target)).alias("correct"),
        F.count("*").alias("rows"),
    )
    bin_of = F.floor(F.col("risk_probability") * _SCORE_BINS).alias("bin")

    def below(order):
        lower = F.sum("others").over(order.rowsBetween(W.unboundedPreceding, -1))
        return F.coalesce(lower, F.lit(0.0))

    in_bin = by_score.select("*", bin_of).withColumn(
        "ordered", F.col("hits") * (below(W.partitionBy("bin").orderBy("risk_probability")) + F.col("others") / 2)
    )
    bins = in_bin.groupBy("bin").agg(
        *[F.sum(name).alias(name) for name in ("ordered", "hits", "others", "correct", "rows")]
    )
    total = bins.withColumn("ordered", F.col("ordered") + F.col("hits") * below(W.orderBy("bin"))).agg(
        *[F.sum(name).alias(name) for name in ("ordered", "hits", "others")],
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("correct", "rows")],
    )
    area = F.col("ordered") / F.nullif(F.col("hits") * F.col("others"), F.lit(0.0))
    return total.select(
        F.round(area, 6).alias("roc_auc"),
        F.col("rows").alias("test_records"),
        (F.col("correct").cast("double") / F.nullif(F.col("rows"), F.lit(0))).alias("accuracy"),
    )


def classification_report(scored_test: DataFrame, target: str = MODEL_TARGET) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy and averages.

    Undefined quotients count as zero. One scan produces the confusion counts.
    """
    cells = scored_test.agg(
        *[
            F.count_if((F.col(target) == actual) & (F.col("predicted_readmit") == predicted)).alias(
                f"n{actual}{predicted}"
            )
            for actual in (0, 1)
            for predicted in (0, 1)
        ]
    )

    def over(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def f1(precision, recall):
        return F.coalesce(
            F.try_divide(2 * F.col(precision) * F.col(recall), F.col(precision) + F.col(recall)),
            F.lit(0.0),
        )

    hits = {0: F.col("n00"), 1: F.col("n11")}
    predicted = {0: F.col("n00") + F.col("n10"), 1: F.col("n01") + F.col("n11")}
    actual = {0: F.col("n00") + F.col("n01"), 1: F.col("n10") + F.col("n11")}
    measured = cells.select(
        *[actual[k].alias(f"s{k}") for k in (0, 1)],
        *[over(hits[k], predicted[k]).alias(f"p{k}") for k in (0, 1)],
        *[over(hits[k], actual[k]).alias(f"r{k}") for k in (0, 1)],
        over(hits[0] + hits[1], actual[0] + actual[1]).alias("accuracy"),
    ).withColumns({f"f{k}": f1(f"p{k}", f"r{k}") for k in (0, 1)})

    def row(name, precision, recall, f1_score, support):
        return F.struct(
            F.lit(name).alias("row"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1_score.alias("f1_score"),
            support.alias("support"),
        )

    total = F.col("s0") + F.col("s1")
    missing = F.lit(None).cast("double")

    def macro(letter):
        return (F.col(f"{letter}0") + F.col(f"{letter}1")) / F.lit(2.0)

    def weighted(letter):
        return over(F.col(f"{letter}0") * F.col("s0") + F.col(f"{letter}1") * F.col("s1"), total)

    rows = [
        *[
            row(CLASS_NAMES[k], F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}"))
            for k in (0, 1)
        ],
        row("accuracy", missing, missing, F.col("accuracy"), total),
        row("macro avg", macro("p"), macro("r"), macro("f"), total),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), total),
    ]
    return measured.select(F.inline(F.array(*rows)))


def coefficients(model: RiskModel, spark: SparkSession) -> DataFrame:
    """Signed and absolute coefficient per feature, smallest effect first."""
    rows = list(zip(model.features, model.coefficients))
    table = spark.createDataFrame(rows, "feature string, coefficient double")
    return table.withColumn("abs_coef", F.abs("coefficient")).orderBy("abs_coef", "feature")


def risk_drivers(coefficient_table: DataFrame, top: int = 3) -> DataFrame:
    """The strongest features that raise and that lower the risk."""
    signed = coefficient_table.where(F.col("coefficient") != 0).withColumn(
        "effect", F.when(F.col("coefficient") > 0, "risk").otherwise("protective")
    )
    strongest = W.partitionBy("effect").orderBy(F.desc("abs_coef"), "feature")
    return (
        signed.withColumn("effect_rank", F.row_number().over(strongest))
        .where(F.col("effect_rank") <= top)
        .select("effect", "effect_rank", "feature", "coefficient")
        .orderBy(F.desc("effect"), "effect_rank")
    )
