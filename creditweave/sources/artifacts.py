"""Saved models: a Spark ML pipeline, its metadata row and the split it was trained on."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from creditweave.operators.calibration import METHODS, UNCALIBRATED, Calibrators
from creditweave.operators.encoding import Encoder
from creditweave.operators.models import FittedModel
from creditweave.operators.monotone import Steps
from creditweave.settings import EVALUATION_SPLITS, MODEL_VERSIONS
from creditweave.sources.staging import path_exists

_METADATA = "kind string, body string"
_REQUIRED = ("model_type", "model_version", "run_id", "feature_columns", "created_at")


class ArtifactError(RuntimeError):
    """A saved model is missing, incomplete or not the expected one."""


@dataclass(frozen=True)
class ModelArtifact:
    model_type: str
    model_version: str
    run_id: str
    feature_columns: list[str]
    created_at: str
    model: FittedModel
    splits: DataFrame
    details: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class CalibrationArtifact:
    base_model_version: str
    selected_method: str
    fitted: Calibrators | None
    created_at: str


def model_path(folder: str, model_type: str) -> str:
    return f"{folder.rstrip('/')}/{model_type}"


def save_model(artifact: ModelArtifact, folder: str) -> str:
    path = model_path(folder, artifact.model_type)
    artifact.model.pipeline.write().overwrite().save(f"{path}/pipeline")
    artifact.splits.select("SK_ID_CURR", "TARGET", "split").write.mode("overwrite").parquet(f"{path}/splits")
    body = {k: getattr(artifact, k) for k in _REQUIRED}
    body |= {"details": artifact.details, "encoder": asdict(artifact.model.encoder)}
    spark = artifact.splits.sparkSession
    row = spark.createDataFrame([("model", json.dumps(body))], _METADATA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return path


def load_model(
    spark: SparkSession,
    folder: str,
    model_type: str,
    expected_version: str | None = None,
    required_splits: Iterable[str] = EVALUATION_SPLITS,
) -> ModelArtifact:
    """Load one model and check its type, version, features, ability to predict and splits."""
    path = model_path(folder, model_type)
    if not path_exists(spark, f"{path}/metadata"):
        raise ArtifactError(f"No saved model at {path}")
    body = json.loads(spark.read.schema(_METADATA).parquet(f"{path}/metadata").first()["body"])
    missing = sorted(k for k in _REQUIRED if k not in body)
    if missing:
        raise ArtifactError(f"{path} lacks {missing}")
    version = expected_version or MODEL_VERSIONS.get(model_type)
    if body["model_type"] != model_type or (version and body["model_version"] != version):
        raise ArtifactError(
            f"{path} holds {body['model_type']}/{body['model_version']}, expected {model_type}/{version}"
        )
    if not body["feature_columns"]:
        raise ArtifactError(f"{path} lists no feature columns")
    pipeline = PipelineModel.load(f"{path}/pipeline")
    if not hasattr(pipeline.stages[-1], "predictProbability"):
        raise ArtifactError(f"{path} cannot predict probabilities")
    splits = spark.read.parquet(f"{path}/splits")
    found = {r[0]: r[1] for r in splits.groupBy("split").count().collect()}
    absent = sorted(set(required_splits) - set(found))
    if absent:
        raise ArtifactError(f"{path} has no saved ids for {absent}")
    if not splits.groupBy("SK_ID_CURR").count().where("count > 1").isEmpty():
        raise ArtifactError(f"{path} assigns an applicant to several splits")
    e = body["encoder"]
    encoder = Encoder(
        tuple(e["numeric"]), tuple(e["categorical"]), e["fills"], e["modes"], e["vocabulary"],
        {k: tuple(v) for k, v in e["scales"].items()},
    )
    model = FittedModel(pipeline, encoder, tuple(body["feature_columns"]))
    return ModelArtifact(
        model=model, splits=splits, details=body.get("details", {}), **{k: body[k] for k in _REQUIRED}
    )


def save_calibration(artifact: CalibrationArtifact, spark: SparkSession, folder: str) -> str:
    path = f"{folder.rstrip('/')}/calibration"
    body: dict[str, Any] = {
        "base_model_version": artifact.base_model_version,
        "selected_method": artifact.selected_method,
        "created_at": artifact.created_at,
    }
    if artifact.fitted is not None:
        body |= {"intercept": artifact.fitted.intercept, "slope": artifact.fitted.slope}
        if artifact.fitted.isotonic is not None:
            artifact.fitted.isotonic.save(f"{path}/isotonic")
    row = spark.createDataFrame([("calibration", json.dumps(body))], _METADATA)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")
    return path


def uncalibrated(version: str) -> CalibrationArtifact:
    return CalibrationArtifact(version, UNCALIBRATED, None, "")


def load_calibration(spark: SparkSession, folder: str, version: str, calibrated_type: str, model_type: str) -> CalibrationArtifact:
    """The calibration of the selected model; other model types are used uncalibrated."""
    if model_type != calibrated_type:
        return uncalibrated(version)
    path = f"{folder.rstrip('/')}/calibration"
    if not path_exists(spark, f"{path}/metadata"):
        raise ArtifactError(f"No saved calibration at {path}")
    body = json.loads(spark.read.schema(_METADATA).parquet(f"{path}/metadata").first()["body"])
    if body["base_model_version"] != version:
        raise ArtifactError(
            f"Calibration belongs to {body['base_model_version']}, not to {version}"
        )
    if body["selected_method"] not in METHODS:
        raise ArtifactError(f"{path} names an unknown method: {body['selected_method']!r}")
    fitted = None
    if "slope" in body:
        isotonic = None
        if path_exists(spark, f"{path}/isotonic"):
            isotonic = Steps.load(spark, f"{path}/isotonic")
        fitted = Calibrators(body["intercept"], body["slope"], isotonic)
    return CalibrationArtifact(version, body["selected_method"], fitted, body["created_at"])
