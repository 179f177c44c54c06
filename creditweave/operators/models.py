"""The two model families, their candidates, predictions and contributions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices, Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.operators.encoding import FEATURES, Encoder, fit_encoder, scaled
from creditweave.operators.reasons import linear_contributions
from creditweave.operators.tree_paths import Paths, collected, explained, leaf_paths, saved_nodes
from creditweave.settings import Settings
from creditweave.sources.workspace import Stored, new_path, shared_folder, store


@dataclass(frozen=True)
class Preset:
    """A named candidate. A depth of -1 leaves the limit to the number of leaves."""

    name: str
    source: str
    n_estimators: int = 300
    learning_rate: float = 0.05
    num_leaves: int = 31
    max_depth: int | None = None
    min_child_samples: int | None = None
    subsample: float = 0.9
    colsample_bytree: float = 0.9
    reg_alpha: float | None = None
    reg_lambda: float | None = None
    class_weight_factor: float = 1.0

    def params(self, class_weight: float) -> dict[str, float | int | None]:
        given = asdict(self)
        factor = given.pop("class_weight_factor")
        del given["name"], given["source"]
        return given | {"scale_pos_weight": class_weight * factor}


# The candidates in the order in which they are tried.
PRESETS = (
    Preset(
        name="baseline_current",
        source="current_default",
    ),
    Preset(
        name="regularized_low_learning_rate",
        source="prior_informed",
        n_estimators=500,
        learning_rate=0.035,
        num_leaves=31,
        max_depth=-1,
        min_child_samples=50,
        subsample=0.85,
        colsample_bytree=0.85,
        reg_alpha=0.05,
        reg_lambda=4.0,
    ),
    Preset(
        name="rank_focused_class_weighted",
        source="prior_informed",
        n_estimators=650,
        learning_rate=0.025,
        num_leaves=63,
        max_depth=-1,
        min_child_samples=35,
        subsample=0.85,
        colsample_bytree=0.8,
        reg_alpha=0.0,
        reg_lambda=3.0,
        class_weight_factor=1.15,
    ),
    Preset(
        name="shallow_calibrated",
        source="prior_informed",
        n_estimators=250,
        learning_rate=0.05,
        num_leaves=7,
        max_depth=3,
        min_child_samples=5,
        subsample=0.9,
        colsample_bytree=0.9,
        reg_alpha=0.1,
        reg_lambda=8.0,
    ),
    Preset(
        name="high_recall_weighted",
        source="prior_informed",
        n_estimators=450,
        learning_rate=0.04,
        num_leaves=47,
        max_depth=-1,
        min_child_samples=25,
        subsample=0.8,
        colsample_bytree=0.85,
        reg_alpha=0.0,
        reg_lambda=2.0,
        class_weight_factor=1.35,
    ),
    Preset(
        name="feature_subsample_regularized",
        source="prior_informed",
        n_estimators=600,
        learning_rate=0.03,
        num_leaves=47,
        max_depth=-1,
        min_child_samples=60,
        subsample=0.75,
        colsample_bytree=0.75,
        reg_alpha=0.1,
        reg_lambda=6.0,
    ),
    Preset(
        name="compact_conservative",
        source="prior_informed",
        n_estimators=350,
        learning_rate=0.05,
        num_leaves=11,
        max_depth=4,
        min_child_samples=60,
        subsample=0.95,
        colsample_bytree=0.95,
        reg_alpha=0.2,
        reg_lambda=8.0,
    ),
    Preset(
        name="lighter_weight_calibrated",
        source="prior_informed",
        n_estimators=500,
        learning_rate=0.035,
        num_leaves=31,
        max_depth=6,
        min_child_samples=45,
        subsample=0.85,
        colsample_bytree=0.9,
        reg_alpha=0.05,
        reg_lambda=4.0,
        class_weight_factor=0.8,
    ),
)


class ModelError(ValueError):
    """A model cannot be fitted or applied as asked."""


@dataclass(frozen=True)
class Candidate:
    name: str
    source: str
    params: dict[str, float | int | None]


@dataclass(frozen=True)
class FittedModel:
    """A pipeline from mart columns to a probability, with the encoder that feeds it."""

    pipeline: PipelineModel
    encoder: Encoder
    features: tuple[str, ...]

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def with_probability(self, rows: DataFrame, name: str = "probability") -> DataFrame:
        found = self.pipeline.transform(rows)
        return found.select(*rows.columns, vector_to_array(F.col("probability"))[1].alias(name))

    def encoded(self, rows: DataFrame) -> DataFrame:
        stages = PipelineModel(self.pipeline.stages[:-1])
        return stages.transform(rows).select(*rows.columns, FEATURES)


def class_sizes(train: DataFrame, target: str = "TARGET") -> tuple[int, int]:
    sizes = {int(r[0]): r[1] for r in train.groupBy(target).count().collect()}
    if set(sizes) != {0, 1}:
        raise ModelError(f"Training rows must hold both classes, got {sorted(sizes)}")
    return sizes[0], sizes[1]


# Second derivatives are a table of width^2; wider models are fitted by Spark's own gradient steps.
MOST_CURVED = 1000
_NEWTON_STEPS = 100


def _curvature(rows: DataFrame, beta: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and second derivatives of the penalised mean loss; `beta` begins with the intercept.

    Each task adds its rows up to one short table; the sums of those are as many rows as entries.
    """
    width = len(beta)
    upper = np.triu_indices(width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 + width + len(upper[0]))
        for batch in batches:
            # At most four million numbers at once.
            for part in pa.Table.from_batches([batch]).to_batches(max(1, (1 << 22) // width)):
                x = np.ones((len(part), width))
                x[:, 1:] = part["x"].flatten().to_numpy().reshape(len(part), width - 1)
                y, w = part["label"].to_numpy(), part["weight"].to_numpy()
                margin = x @ beta
                p = np.exp(-np.logaddexp(0.0, -margin))
                totals[0] += w.sum()
                totals[1] += w @ (np.logaddexp(0.0, margin) - y * margin)
                totals[2 : 2 + width] += x.T @ (w * (p - y))
                totals[2 + width :] += (x.T @ (x * (w * p * (1.0 - p))[:, None]))[upper]
        if totals[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals))), pa.array(totals)], names=["place", "value"])

    columns = rows.select(vector_to_array(F.col(FEATURES)).alias("x"), "label", "weight")
    found = columns.mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    totals = np.zeros(found.num_rows)
    totals[found["place"].to_numpy()] = found["value"].to_numpy()
    totals[1:] /= totals[0]
    second = np.zeros((width, width))
    second[upper] = totals[2 + width :]
    second = second + np.triu(second, 1).T
    shrink = np.full(width, penalty)
    shrink[0] = 0.0
    value = totals[1] + 0.5 * float(shrink @ beta**2)
    return value, totals[2 : 2 + width] + shrink * beta, second + np.diag(shrink)


def newton_logistic(rows: DataFrame, width: int, penalty: float) -> np.ndarray:
    """Intercept and coefficients at the minimum of the penalised mean logistic loss.

    Newton's steps need about ten passes whatever the number of rows; gradient steps need hundreds, the more the
    weaker the penalty is. A step that does not lower the loss is halved.
    """
    beta = np.zeros(width + 1)
    value, slope, second = _curvature(rows, beta, penalty)
    for _ in range(_NEWTON_STEPS):
        step = np.linalg.lstsq(second, slope, rcond=None)[0]
        # Half of this is what the step gains.
        gain = float(slope @ step)
        if gain <= 1e-13 * max(1.0, abs(value)):
            return beta
        size = 1.0
        while True:
            moved = beta - size * step
            found = _curvature(rows, moved, penalty)
            if found[0] <= value - 1e-4 * size * gain + 1e-14 * abs(value):
                break
            size /= 2
            if size < 1e-6:
                return beta
        beta, (value, slope, second) = moved, found
    raise ModelError(f"The logistic fit has not settled after {_NEWTON_STEPS} steps")


def fit_logistic(
    train: Stored,
    features: Sequence[str],
    settings: Settings = Settings(),
    target: str = "TARGET",
    encoder: Encoder | None = None,
) -> FittedModel:
    """L2 logistic regression (C = 1) on scaled features with balanced class weights.

    An unscaled encoder of the same rows, where one is given, is scaled instead of fitting one.
    """
    encoder = scaled(encoder, train) if encoder else fit_encoder(train, features, scaled=True)
    negatives, positives = class_sizes(train.frame, target)
    n = negatives + positives
    weight: Column = F.lit(1.0)
    if settings.class_weighting:
        weight = F.when(F.col(target) == 1, n / (2.0 * positives)).otherwise(n / (2.0 * negatives))
    stages = PipelineModel(encoder.stages(train.frame.sparkSession))
    rows = store(
        stages.transform(train.frame).select(
            FEATURES, F.col(target).cast("double").alias("label"), weight.alias("weight")
        ),
        "encoded",
    ).frame
    # The objective is a mean here, so C = 1 is a penalty of 1 / n.
    learner = LogisticRegression(
        featuresCol=FEATURES,
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        tol=1e-8,
    )
    width = len(encoder.positions())
    if width < MOST_CURVED:
        # Equal bounds hold the learner at the minimum, so that its model is an ordinary one.
        beta = newton_logistic(rows, width, 1.0 / n)
        at = {"Coefficients": Matrices.dense(1, width, beta[1:]), "Intercepts": Vectors.dense(beta[:1])}
        for name, value in at.items():
            learner = learner.copy({learner.getParam(f"{end}BoundsOn{name}"): value for end in ("lower", "upper")})
        learner = learner.setMaxIter(0)
    # A model that was just fitted drags its training summary, and with it the session, into
    # every task; a saved and loaded one holds only its coefficients.
    path = new_path(train.frame.sparkSession, "logistic")
    learner.fit(rows).write().save(path)
    model = LogisticRegressionModel.load(path)
    return FittedModel(PipelineModel([*stages.stages, model]), encoder, tuple(features))


def tree_candidates(class_weight: float, settings: Settings = Settings()) -> list[Candidate]:
    """The first ``max_candidates`` presets, or only the first one without tuning."""
    if settings.max_candidates < 1:
        raise ModelError("max_candidates must be at least 1")
    wanted = PRESETS[: settings.max_candidates if settings.tuning_enabled else 1]
    return [Candidate(p.name, p.source, p.params(class_weight)) for p in wanted]


def tree_depth(params: dict) -> int:
    """The depth that allows the wanted number of leaves."""
    depth = params.get("max_depth") or -1
    return depth if depth > 0 else math.ceil(math.log2(params["num_leaves"]))


def fit_trees(
    encoded: DataFrame, encoder: Encoder, candidate: Candidate, seed: int, stages: PipelineModel
) -> FittedModel:
    """Gradient-boosted trees on (features, label) rows.

    The number of leaves limits the depth; the two regularisation terms have no counterpart.
    """
    context = encoded.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(encoded.sparkSession))
    p = candidate.params
    rows = encoded.withColumn(
        "weight", F.when(F.col("label") == 1, F.lit(float(p["scale_pos_weight"]))).otherwise(1.0)
    )
    learner = GBTClassifier(
        featuresCol=FEATURES,
        labelCol="label",
        weightCol="weight",
        maxIter=int(p["n_estimators"]),
        stepSize=float(p["learning_rate"]),
        maxDepth=tree_depth(p),
        minInstancesPerNode=int(p["min_child_samples"] or 20),
        subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=str(float(p["colsample_bytree"])),
        seed=seed,
    )
    model = learner.fit(rows)
    features = (*encoder.numeric, *encoder.categorical)
    return FittedModel(PipelineModel([*stages.stages, model]), encoder, features)


# Rows of one task of the tree fit, about 200 MB of binned points.
_TREE_ROWS = 250_000


def encode_training(
    train: Stored, features: Sequence[str], target: str = "TARGET", encoder: Encoder | None = None
) -> tuple[Stored, Encoder, PipelineModel]:
    """Encoded training rows, written once for all tree candidates.

    They are dealt evenly to a multiple of the cores: every level of every tree waits for the largest part.
    """
    spark = train.frame.sparkSession
    encoder = encoder or fit_encoder(train, features, scaled=False)
    stages = PipelineModel(encoder.stages(spark))
    rows = stages.transform(train.frame).select(
        FEATURES, F.col(target).cast("double").alias("label")
    )
    cores = spark.sparkContext.defaultParallelism
    parts = cores * max(1, math.ceil(train.rows / (cores * _TREE_ROWS)))
    return store(rows.repartition(parts), "encoded"), encoder, stages


# --- contributions ---------------------------------------------------------------------


def logistic_contributions(
    model: FittedModel, rows: DataFrame, background: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """(keys, contributions): coefficient * (value - background mean) per encoded position."""
    means = (
        model.encoded(background).select(Summarizer.mean(F.col(FEATURES)).alias("m")).first()["m"]
    )
    values = vector_to_array(F.col(FEATURES))
    found = linear_contributions(values, list(model.classifier.coefficients), list(means))
    return model.encoded(rows).select(*keys, found.alias("contributions"))


def tree_paths(model: FittedModel, spark: SparkSession) -> Paths:
    """The leaf paths of a fitted ensemble in log-odds, from its saved node table."""
    path = new_path(spark, "trees")
    model.classifier.write().save(path)
    nodes = saved_nodes(spark, path)
    # The margin is twice the weighted sum of the trees.
    return collected(leaf_paths(nodes.withColumn("weight", 2.0 * F.col("weight"))))


def tree_contributions(
    model: FittedModel, rows: DataFrame, keys: Sequence[str], paths: Paths | None = None
) -> DataFrame:
    """(keys, contributions): path-dependent Shapley values of the log-odds per position.

    Only the keys and the encoded vector reach Python.
    """
    keys = list(keys)
    encoded = model.encoded(rows).select(*keys, vector_to_array(F.col(FEATURES)).alias(FEATURES))
    return explained(encoded, FEATURES, keys, paths or tree_paths(model, rows.sparkSession))
