"""Imputation, scaling and one-hot encoding with statistics taken from the training rows.

The statistics are exact: medians come from bounded quantile passes, modes and vocabularies
from one grouped count over all categorical columns. They become ordinary Spark ML stages, so
a fitted model is saved and loaded as one pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.functions.labels import feature_label
from creditweave.operators.quantiles import exact_quantiles
from creditweave.sources.workspace import Stored, store

FEATURES = "features"
MISSING_CATEGORY = "missing"
# Vocabularies become stages of the model, which the driver holds; a wider column is an error.
MOST_CATEGORIES = 10_000


def column_kinds(frame: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names by type, in feature order."""
    kinds = {f.name: f.dataType for f in frame.schema}
    numeric = [c for c in features if isinstance(kinds[c], T.NumericType)]
    return numeric, [c for c in features if c not in set(numeric)]


def category_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) of all categorical columns, NULLs left out."""
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    return (
        frame.select(F.explode(F.array(*entries)).alias("e"))
        .where("e.value IS NOT NULL")
        .groupBy("e.column_name", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def modes(counts: DataFrame) -> DataFrame:
    """The most frequent value per column; of equally frequent ones the smallest."""
    return counts.groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode")
    )


@dataclass(frozen=True)
class Encoder:
    """Fitted statistics; ``scales`` is empty for models that do not scale."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    fills: dict[str, float]
    modes: dict[str, str]
    vocabulary: dict[str, list[str]]
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def positions(self) -> list[tuple[str, str | None]]:
        """(feature, category) of every position of the encoded vector."""
        plain = [(c, None) for c in self.numeric]
        return plain + [(c, v) for c in self.categorical for v in self.vocabulary[c]]

    def numeric_sql(self, name: str) -> str:
        filled = f"coalesce(CAST(`{name}` AS DOUBLE), CAST({self.fills[name]!r} AS DOUBLE))"
        if name not in self.scales:
            return filled
        mean, scale = self.scales[name]
        return f"({filled} - CAST({mean!r} AS DOUBLE)) / CAST({scale!r} AS DOUBLE)"

    def category_sql(self, name: str) -> str:
        default = self.modes[name].replace("\\", "\\\\").replace("'", "\\'")
        return f"coalesce(CAST(`{name}` AS STRING), '{default}')"

    def stages(self, spark: SparkSession) -> list[Transformer]:
        columns = [f"{self.numeric_sql(c)} AS `{c}__in`" for c in self.numeric]
        columns += [f"{self.category_sql(c)} AS `{c}__text`" for c in self.categorical]
        stages: list[Transformer] = [
            SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")
        ]
        inputs = [f"{c}__in" for c in self.numeric]
        if self.categorical:
            # One indexer per column: a joint one pads shorter vocabularies with nulls.
            indexers = [
                StringIndexerModel.from_labels(
                    self.vocabulary[c],
                    inputCol=f"{c}__text",
                    outputCol=f"{c}__index",
                    handleInvalid="keep",
                )
                for c in self.categorical
            ]
            hot = OneHotEncoder(
                inputCols=[f"{c}__index" for c in self.categorical],
                outputCols=[f"{c}__hot" for c in self.categorical],
                dropLast=True,  # drops the extra index of unseen values
            )
            # The sizes come from the indexers' metadata, so an empty frame is enough.
            schema = T.StructType([T.StructField(f"{c}__text", T.StringType()) for c in self.categorical])
            empty = PipelineModel(indexers).transform(spark.createDataFrame([], schema))
            stages += [*indexers, hot.fit(empty)]
            inputs += [f"{c}__hot" for c in self.categorical]
        return [*stages, VectorAssembler(inputCols=inputs, outputCol=FEATURES)]

    def labels(self, spark: SparkSession) -> list[str]:
        """Readable label per position; as many rows as the model has inputs."""
        rows = [(i, f, c) for i, (f, c) in enumerate(self.positions())]
        frame = spark.createDataFrame(rows, "i int, feature string, category string")
        found = frame.select("i", feature_label("feature", "category").alias("label")).collect()
        return [r["label"] for r in sorted(found)]


def fit_encoder(train: Stored, features: Sequence[str], scaled: bool) -> Encoder:
    frame = train.frame
    numeric, categorical = column_kinds(frame, features)
    medians = exact_quantiles(train, numeric, [0.5])
    fills = {c: 0.0 if medians[c][0] is None else float(medians[c][0]) for c in numeric}
    vocabulary: dict[str, list[str]] = {c: [] for c in categorical}
    mode_of: dict[str, str] = {}
    if categorical:
        counts = store(category_counts(frame, categorical), "categories").frame
        per_column = counts.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("values"),
            F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("mode"),
        )
        for row in per_column.collect():
            if row["values"] > MOST_CATEGORIES:
                raise ValueError(
                    f"{row['column_name']} has {row['values']} categories, more than {MOST_CATEGORIES}"
                )
            mode_of[row["column_name"]] = row["mode"]
        for row in counts.select("column_name", "value").orderBy("column_name", "value").collect():
            vocabulary[row["column_name"]].append(row["value"])
    for c in categorical:
        if not vocabulary[c]:
            vocabulary[c], mode_of[c] = [MISSING_CATEGORY], MISSING_CATEGORY
    encoder = Encoder(tuple(numeric), tuple(categorical), fills, mode_of, vocabulary)
    return _with_scales(encoder, frame) if scaled and numeric else encoder


def scaled(encoder: Encoder, train: Stored) -> Encoder:
    """An encoder of these rows, with their means and deviations."""
    return _with_scales(encoder, train.frame) if encoder.numeric else encoder


def _with_scales(encoder: Encoder, frame: DataFrame) -> Encoder:
    filled = {c: F.expr(encoder.numeric_sql(c)) for c in encoder.numeric}
    row = frame.agg(
        *[
            stat.alias(f"{kind}{i}")
            for i, c in enumerate(encoder.numeric)
            for kind, stat in (("m", F.avg(filled[c])), ("s", F.stddev_pop(filled[c])))
        ]
    ).first()
    scales = {
        c: (float(row[f"m{i}"]), float(row[f"s{i}"]) or 1.0) for i, c in enumerate(encoder.numeric)
    }
    return Encoder(
        encoder.numeric, encoder.categorical, encoder.fills, encoder.modes, encoder.vocabulary, scales
    )
