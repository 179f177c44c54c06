"""Stratified, reproducible splits and the joins that use them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditweave.functions.expressions import ratio
from creditweave.operators.ordering import ranked
from creditweave.schemas import REPORTS
from creditweave.settings import TRAIN_POPULATION, Settings
from creditweave.sources.workspace import Stored, stored


class SplitError(ValueError):
    """A split is empty, has one class only, or no longer matches the mart."""


def _share(total: int, sizes: dict[int, int]) -> dict[int, int]:
    """Divide a total over classes in proportion to their sizes (largest remainder)."""
    everything = sum(sizes.values())
    exact = {c: total * n / everything for c, n in sizes.items()}
    given = {c: math.floor(x) for c, x in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (given[c] - exact[c], c))
    for c in by_remainder[: total - sum(given.values())]:
        given[c] += 1
    return given


def split_quotas(sizes: dict[int, int], settings: Settings) -> dict[int, tuple[int, int]]:
    """Per class: how many rows go to (test, validation)."""
    holdout_size = settings.validation_size + settings.test_size
    if not 0 < holdout_size < 1 or min(settings.validation_size, settings.test_size) <= 0:
        raise SplitError("Validation and test split sizes must be positive and sum below 1")
    if set(sizes) != {0, 1}:
        raise SplitError(f"Labeled rows must hold both classes, got {sorted(sizes)}")
    held_total = math.ceil(sum(sizes.values()) * holdout_size)
    held = _share(held_total, sizes)
    test = _share(math.ceil(held_total * (settings.test_size / holdout_size)), held)
    quotas = {c: (test[c], held[c] - test[c]) for c in sizes}
    for c, (n_test, n_validation) in quotas.items():
        if not (n_test and n_validation and sizes[c] > n_test + n_validation):
            raise SplitError("Every split must contain both target classes")
    return quotas


def stratified_split(
    labeled: DataFrame | Stored, settings: Settings = Settings()
) -> DataFrame:
    """(SK_ID_CURR, TARGET, split): exact class quotas, chosen by a hash of seed and id."""
    source = stored(labeled, "labeled")
    rows = Stored(source.frame.select("SK_ID_CURR", F.col("TARGET").cast("int").alias("TARGET")), source.rows)
    sizes = {r["TARGET"]: r["count"] for r in rows.frame.groupBy("TARGET").count().collect()}
    quotas = split_quotas(sizes, settings)
    lottery = F.md5(F.concat_ws(":", F.lit(settings.seed), F.col("SK_ID_CURR")))
    drawn = ranked(
        Stored(rows.frame.withColumn("_lot", lottery), rows.rows),
        ["TARGET"],
        [F.col("_lot").asc(), F.col("SK_ID_CURR").asc()],
        (),
    )

    def quota(upto: int):
        return F.when(F.col("TARGET") == 1, sum(quotas[1][:upto])).otherwise(sum(quotas[0][:upto]))

    return drawn.select(
        "SK_ID_CURR",
        "TARGET",
        F.when(F.col("rank") <= quota(1), "test")
        .when(F.col("rank") <= quota(2), "validation")
        .otherwise("train")
        .alias("split"),
    )


def split_summary(splits: DataFrame, version: str, run_id: str, created_at: str) -> DataFrame:
    rows, positives = F.count(F.lit(1)), F.sum("TARGET")
    return (
        splits.groupBy("split")
        .agg(
            rows.alias("row_count"),
            positives.alias("positive_count"),
            (rows - positives).alias("negative_count"),
            ratio(positives, rows).alias("positive_rate"),
        )
        .select(
            F.lit(version).alias("model_version"),
            F.lit(run_id).alias("run_id"),
            "split",
            "row_count",
            "positive_count",
            "negative_count",
            "positive_rate",
            F.lit(created_at).alias("created_at"),
        )
        .select(*REPORTS["split_summary"])
    )


def split_rows(mart: DataFrame, splits: DataFrame, columns: Iterable[str] = ()) -> DataFrame:
    """Labeled mart rows with their split, for all splits in one join."""
    labeled = mart.where(F.col("source_population") == TRAIN_POPULATION)
    keep = ["SK_ID_CURR", "TARGET", *columns]
    return labeled.select(*dict.fromkeys(keep)).join(
        splits.select("SK_ID_CURR", "split"), "SK_ID_CURR"
    )


def segment_rows(
    mart: DataFrame, diagnostics: DataFrame, splits: DataFrame, features: Iterable[str],
    segments: Iterable[str],
) -> DataFrame:
    """Split rows together with the segment fields kept outside the mart."""
    features, segments = list(features), list(segments)
    for name, frame, wanted in (
        ("mart_credit_risk_features", mart, features),
        ("segment_diagnostics", diagnostics, segments),
    ):
        missing = sorted(set(wanted) - set(frame.columns))
        if missing:
            raise SplitError(f"{name} is missing columns: {missing}")
    fields = diagnostics.where(F.col("source_population") == TRAIN_POPULATION)
    return split_rows(mart, splits, features).join(
        fields.select("SK_ID_CURR", *segments), "SK_ID_CURR"
    )


def missing_ids(expected: DataFrame, present: DataFrame, key: str = "SK_ID_CURR") -> DataFrame:
    """Ids that are expected but not present. Both sides are reduced to ids before they meet."""
    return expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def split_violations(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """What is wrong with loaded split rows: (split, problem, n). Empty when all is well."""
    saved = splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("saved"), F.count_distinct("SK_ID_CURR").alias("ids")
    )
    loaded = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(F.col("TARGET").isNull()).alias("unlabeled"),
        F.count_if(F.col("TARGET") == 0).alias("negatives"),
        F.count_if(F.col("TARGET") == 1).alias("positives"),
    )
    zero = F.lit(0)
    n = {c: F.coalesce(F.col(c), zero) for c in ("saved", "ids", "loaded", "unlabeled", "negatives", "positives")}
    problems = {
        "saved ids repeat": n["saved"] - n["ids"],
        "saved ids missing from the mart": n["saved"] - n["loaded"],
        "targets not observed": n["unlabeled"],
        "only one target class": F.when((n["negatives"] == 0) | (n["positives"] == 0), 1).otherwise(0),
    }
    entries = [F.struct(F.lit(p).alias("problem"), v.cast("long").alias("n")) for p, v in problems.items()]
    # Rows without a split are a split of their own on both sides.
    loaded = loaded.withColumnRenamed("split", "loaded_split")
    same = saved["split"].eqNullSafe(loaded["loaded_split"])
    return (
        saved.join(loaded, same, "full")
        .select(F.coalesce("split", "loaded_split").alias("split"), F.explode(F.array(*entries)).alias("e"))
        .select("split", "e.*")
        .where("n <> 0")
    )


def require_split_rows(rows: DataFrame, splits: DataFrame) -> None:
    problems = split_violations(rows, splits).collect()
    if problems:
        # The ten smallest, a top-k, so that the message is the same every time.
        missing = missing_ids(splits, rows)
        ids = [r[0] for r in missing.orderBy(missing.columns[0]).limit(10).collect()]
        detail = "; ".join(f"{r['split']}: {r['problem']} ({r['n']})" for r in problems)
        raise SplitError(f"Split rows do not reconcile: {detail}; first missing ids {sorted(ids)}")
