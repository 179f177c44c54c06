"""Readable feature labels and the check for terms that must not be shown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import col


def humanize(token: Column | str) -> Column:
    """``bureau_credit_count`` -> ``Bureau credit count``."""
    words = F.lower(F.trim(F.regexp_replace(col(token), r"[_\s]+", " ")))
    sentence = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))
    return F.when(words == "", "Unknown feature").otherwise(sentence)


def feature_label(feature: Column | str, category: Column | str) -> Column:
    """``Label`` for numeric features, ``Label: category`` for encoded categories."""
    return F.concat_ws(": ", humanize(feature), humanize(category))


def plain_text(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(text)), r"[_\s]+", " "))


def forbidden_text(frame: DataFrame, columns: Iterable[str], terms: Iterable[str]) -> DataFrame:
    """Rows (column_name, text, term) whose text holds an excluded term."""
    needles = F.array(*[plain_text(F.lit(t)) for t in sorted(terms)])
    long = frame.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in columns])
        ).alias("_entry")
    ).select("_entry.*")
    return (
        long.where(F.col("text").isNotNull())
        .withColumn(
            "term",
            F.explode(F.filter(needles, lambda t: F.contains(plain_text("text"), t))),
        )
        .distinct()
    )
