"""Probability calibration fitted on validation scores."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import logit, sigmoid
from creditweave.operators.monotone import Steps, fit_steps

UNCALIBRATED, SIGMOID, ISOTONIC = "uncalibrated", "sigmoid", "isotonic"
METHODS = (UNCALIBRATED, SIGMOID, ISOTONIC)
SMALLEST_GAIN = 0.0005
SIGMOID_TOLERANCE = 0.0005


class CalibrationError(ValueError):
    """Calibration cannot be fitted or applied."""


@dataclass(frozen=True)
class Calibrators:
    intercept: float
    slope: float
    isotonic: Steps | None = None


def fit_sigmoid(validation: DataFrame) -> Calibrators:
    """Logistic regression (C = 1) of the target on the log-odds of the score."""
    rows = VectorAssembler(inputCols=["log_odds"], outputCol="x").transform(
        validation.select(
            logit("probability").alias("log_odds"), F.col("target").cast("double").alias("label")
        )
    )
    n = rows.count()
    if not n:
        raise CalibrationError("No validation row to calibrate on")
    model = LogisticRegression(
        featuresCol="x", labelCol="label", regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-10,
    ).fit(rows)
    return Calibrators(float(model.intercept), float(model.coefficients[0]))


def fit_isotonic(validation: DataFrame) -> Steps:
    """Monotone step fit, pooled in parallel."""
    return fit_steps(validation)


def fit_calibrators(validation: DataFrame) -> Calibrators:
    line = fit_sigmoid(validation)
    return Calibrators(line.intercept, line.slope, fit_isotonic(validation))


def apply_method(rows: DataFrame, method: str, fitted: Calibrators | None) -> DataFrame:
    """Add ``calibrated``: the probability after one method."""
    if method == UNCALIBRATED:
        return rows.withColumn("calibrated", F.col("probability"))
    if fitted is None:
        raise CalibrationError(f"Nothing was fitted that {method} could apply")
    if method == SIGMOID:
        margin = F.lit(fitted.intercept) + F.lit(fitted.slope) * logit("probability")
        return rows.withColumn("calibrated", sigmoid(margin))
    if method == ISOTONIC and fitted.isotonic is not None:
        found = fitted.isotonic.at(rows, "probability", "calibrated")
        inside = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
        return found.select(*rows.columns, inside.alias("calibrated"))
    raise CalibrationError(f"No way to apply the method {method!r}")


def choose_method(validation_brier: Mapping[str, float]) -> str:
    """None unless it helps; sigmoid unless another method is clearly better."""
    missing = sorted(set(METHODS) - set(validation_brier))
    if missing:
        raise CalibrationError(f"The comparison has no Brier score for {missing}")
    best = min(METHODS, key=lambda m: validation_brier[m])
    if validation_brier[UNCALIBRATED] - validation_brier[best] < SMALLEST_GAIN:
        return UNCALIBRATED
    if validation_brier[SIGMOID] - validation_brier[best] <= SIGMOID_TOLERANCE:
        return SIGMOID
    return best


def brier_by_method(comparison: Any) -> dict[str, float]:
    """Validation Brier score per method from comparison rows (three rows)."""
    rows = comparison.where("split = 'validation'").select("calibration_method", "brier_score")
    return {r["calibration_method"]: float(r["brier_score"]) for r in rows.collect()}
