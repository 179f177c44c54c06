"""Score rows of the batch score table and their way back to the features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.operators.contracts import ContractError
from creditweave.operators.metrics import with_tenth
from creditweave.operators.policy import Thresholds, band_action, band_label, risk_band
from creditweave.schemas import SCORE_SCHEMA
from creditweave.settings import (
    HOLDOUT_SCORING,
    TEST_POPULATION,
    TRAIN_POPULATION,
    UNLABELED_SCORING,
)
from creditweave.sources.workspace import Stored, store


def score_rows(
    scored: DataFrame | Stored,
    thresholds: Thresholds,
    threshold_version: str,
    model_version: str,
    calibration_method: str,
    scored_at: datetime,
) -> DataFrame:
    """Score table rows from (SK_ID_CURR, scoring_population, target, probability, calibrated).

    Bands and deciles come from the raw probability; decile 1 is the riskiest tenth of each
    scoring population.
    """
    ranked = with_tenth(scored, "score_decile", True, ("scoring_population",))
    band = risk_band("probability", thresholds)
    empty = F.lit(None).cast("string")
    values = {
        "applicant_id": F.col("SK_ID_CURR"),
        "observed_target": F.col("target"),
        "score": F.col("probability"),
        "raw_risk_score": F.col("probability"),
        "calibrated_risk_score": F.col("calibrated"),
        "calibration_method": F.lit(calibration_method),
        "risk_band": band_label(band),
        "recommended_action": band_action(band),
        "threshold_version": F.lit(threshold_version),
        "model_version": F.lit(model_version),
        "top_reason_1": empty,
        "top_reason_2": empty,
        "top_reason_3": empty,
        "scored_at": F.lit(scored_at),
    }
    return ranked.select(
        *[
            values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in SCORE_SCHEMA
        ]
    )


def scored_features(scores: DataFrame, mart: DataFrame, version: str, features: list[str]) -> DataFrame:
    """Scored rows of one model with their mart features.

    The scoring population decides which mart population a row belongs to; as a computed key
    this is a plain equi-join.
    """
    population = (
        F.when(F.col("scoring_population") == HOLDOUT_SCORING, TRAIN_POPULATION)
        .when(F.col("scoring_population") == UNLABELED_SCORING, TEST_POPULATION)
    )
    wanted = scores.where(F.col("model_version") == version).select(
        "applicant_id",
        "scoring_population",
        "model_version",
        "threshold_version",
        "score",
        F.col("applicant_id").alias("SK_ID_CURR"),
        population.alias("source_population"),
    )
    return wanted.join(
        mart.select("SK_ID_CURR", "source_population", *features), ["SK_ID_CURR", "source_population"]
    ).drop("SK_ID_CURR", "source_population")


def require_all_scored(scores: DataFrame, joined: DataFrame | Stored, version: str) -> Stored:
    """The join to the features must neither lose nor multiply scored rows."""
    kept = joined if isinstance(joined, Stored) else store(joined, "scored-features")
    expected = scores.where(F.col("model_version") == version).count()
    if expected == 0:
        raise ContractError(f"The score table holds no rows of {version}")
    if kept.rows != expected:
        raise ContractError(
            f"{expected} scores of {version} met {kept.rows} rows of the mart"
        )
    return kept
