"""Metrics per segment value, for several one-dimensional segmentations in one pass.

Rows are added up by all segment values and score; only these sums are copied once for each segmentation, and
ranks are prefix sums over the distinct scores of a segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.operators.metrics import GROUPS, curve_measures, distinct_scores
from creditweave.settings import SEGMENT_DIMENSIONS


def segment_text(column: Column, kind: T.DataType) -> Column:
    """``missing`` for NULL; whole numbers without a decimal point."""
    text = column.cast("string")
    if isinstance(kind, T.DoubleType):
        text = F.when(column == F.floor(column), column.cast("bigint").cast("string")).otherwise(text)
    return F.coalesce(text, F.lit("missing"))


def segment_performance(
    predictions: DataFrame,
    dimensions: Sequence[str] = SEGMENT_DIMENSIONS,
) -> DataFrame:
    """One row per (model, split, dimension, value); ranks are NULL for single-class segments.

    The order is by segment and score, so a segment that holds most applicants is spread over as
    many tasks as its scores need.
    """
    kinds = {f.name: f.dataType for f in predictions.schema}
    values = {f"_{i}": segment_text(F.col(d), kinds[d]) for i, d in enumerate(dimensions)}
    summed = predictions.groupBy(*GROUPS, "probability", *[v.alias(n) for n, v in values.items()]).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("target").cast("bigint").alias("positives")
    )
    entries = [
        F.struct(F.lit(d).alias("segment_name"), F.col(n).alias("segment_value"))
        for d, n in zip(dimensions, values, strict=True)
    ]
    long = summed.select(*GROUPS, "probability", "rows", "positives", F.explode(F.array(*entries)).alias("_e"))
    groups = (*GROUPS, "segment_name", "segment_value")
    curve = distinct_scores(long.select(*GROUPS, "_e.*", "probability", "rows", "positives"), groups)
    found = curve.groupBy(*groups).agg(*[m.alias(n) for n, m in curve_measures().items()])
    return found.select(
        *groups,
        F.col("rows").alias("applicant_count"),
        F.col("positive_rate").alias("observed_default_rate"),
        "average_score",
        "roc_auc",
        "pr_auc",
        "brier_score",
    )
