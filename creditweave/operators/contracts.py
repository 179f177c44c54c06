"""Data contracts as jobs: every check adds rows (check, detail, n) to one violations frame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditweave.operators.inventory import duplicate_keys, feature_inventory, profile
from creditweave.schemas import REPORTS
from creditweave.settings import (
    BASELINE_TYPE,
    TEST_POPULATION,
    TRAIN_POPULATION,
    TREES_TYPE,
    Settings,
)
from creditweave.sources.workspace import new_path

MART = "mart_credit_risk_features"
DIAGNOSTICS = "segment_diagnostics"
VIOLATION_SCHEMA = "check string, detail string, n long"


class ContractError(RuntimeError):
    """The tables violate their contract; a report table lists every violation."""


@dataclass(frozen=True)
class TableContract:
    name: str
    layer: str
    grain: tuple[str, ...]


_POPULATION_GRAIN = ("SK_ID_CURR", "source_population")
_V1 = (
    TableContract("stg_application_train", "staging", ("SK_ID_CURR",)),
    TableContract("stg_application_test", "staging", ("SK_ID_CURR",)),
    TableContract("stg_bureau", "staging", ("SK_ID_BUREAU",)),
    TableContract("stg_previous_application", "staging", ("SK_ID_PREV",)),
    # Reported only: the table holds many rows per applicant.
    TableContract("stg_installments_payments", "staging", ("SK_ID_CURR",)),
    TableContract("f_applicant_static", "feature", _POPULATION_GRAIN),
    TableContract(DIAGNOSTICS, "diagnostic", _POPULATION_GRAIN),
    TableContract("f_bureau_agg", "feature", ("SK_ID_CURR",)),
    TableContract("f_previous_application_agg", "feature", ("SK_ID_CURR",)),
    TableContract("f_installments_agg", "feature", ("SK_ID_CURR",)),
    TableContract(MART, "mart", _POPULATION_GRAIN),
)
_LATER = (
    TableContract("stg_bureau_balance", "staging", ("SK_ID_BUREAU", "MONTHS_BALANCE")),
    TableContract("stg_pos_cash_balance", "staging", ("SK_ID_PREV", "MONTHS_BALANCE")),
    TableContract("stg_credit_card_balance", "staging", ("SK_ID_PREV", "MONTHS_BALANCE")),
    TableContract("f_bureau_balance_agg", "feature", ("SK_ID_CURR",)),
    TableContract("f_pos_cash_agg", "feature", ("SK_ID_CURR",)),
    TableContract("f_credit_card_agg", "feature", ("SK_ID_CURR",)),
)
DIAGNOSTIC_COLUMNS = (
    "CODE_GENDER",
    "NAME_FAMILY_STATUS",
    "applicant_age_years",
    "applicant_age_band",
    "CNT_CHILDREN",
    "CNT_FAM_MEMBERS",
)


def required_tables(post_v1: bool) -> tuple[TableContract, ...]:
    return _V1 + _LATER if post_v1 else _V1


def model_features(mart: DataFrame, settings: Settings = Settings()) -> list[str]:
    """Mart columns that may enter a model, in mart order."""
    excluded = settings.exclusion_groups()
    return [c for c in mart.columns if c not in excluded]


def _facts(spark: SparkSession, rows: Iterable[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), VIOLATION_SCHEMA)


def _counted(frame: DataFrame, checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Several aggregate counts of one pass as violation rows; zero counts are dropped."""
    totals = frame.agg(*[n.cast("long").alias(f"n{i}") for i, (_, _, n) in enumerate(checks)])
    entries = [
        F.struct(F.lit(c).alias("check"), F.lit(d).alias("detail"), F.col(f"n{i}").alias("n"))
        for i, (c, d, _) in enumerate(checks)
    ]
    return totals.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where("n <> 0")


def schema_violations(
    tables: Mapping[str, DataFrame], settings: Settings
) -> list[tuple[str, str, int]]:
    """Checks on column names alone; they need no job."""
    found = []
    mart = set(tables[MART].columns)
    for name in ("SK_ID_CURR", "source_population", "TARGET"):
        if name not in mart:
            found.append(("mart is missing a required column", name, 1))
    for name in settings.excluded["sensitive_or_protected_status_like"]:
        if name in mart:
            found.append(("diagnostic-only column in the mart", name, 1))
    for name in DIAGNOSTIC_COLUMNS:
        if name not in tables[DIAGNOSTICS].columns:
            found.append(("diagnostics are missing a column", name, 1))
    return found


def mart_violations(mart: DataFrame, settings: Settings) -> DataFrame:
    """Targets, emptiness and all-missing features in one pass, then grain and population."""
    train = F.col("source_population") == TRAIN_POPULATION
    test = F.col("source_population") == TEST_POPULATION
    target, rows = F.col("TARGET"), F.count(F.lit(1))
    features = model_features(mart, settings)
    checks = [
        ("train TARGET is null", TRAIN_POPULATION, F.count_if(train & target.isNull())),
        ("train TARGET is not binary", TRAIN_POPULATION, F.count_if(train & ~target.isin(0, 1))),
        ("test TARGET is not null", TEST_POPULATION, F.count_if(test & target.isNotNull())),
        ("mart is empty", MART, F.when(rows == 0, 1).otherwise(0)),
        *[
            ("model feature is 100% missing", c, F.when((rows > 0) & (F.count(c) == 0), 1).otherwise(0))
            for c in features
        ],
    ]
    strangers = (
        mart.where(F.col("source_population").isNull() | ~(train | test))
        .groupBy(F.coalesce("source_population", F.lit("NULL")).alias("detail"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("unexpected source_population").alias("check"), "detail", "n")
    )
    return (
        _counted(mart, checks)
        .unionByName(strangers)
        .unionByName(grain_violations(MART, mart, _POPULATION_GRAIN))
    )


def grain_violations(name: str, frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _counted(
        duplicate_keys(frame, keys), [("duplicate grain keys", name, F.count(F.lit(1)))]
    )


def reconciliation(train: DataFrame, test: DataFrame, mart: DataFrame) -> DataFrame:
    """(source_population, staging_rows, mart_rows) for both populations."""
    # Every table is counted on its own; no rows are moved but the counts.
    counts = [
        train.select(F.lit(TRAIN_POPULATION).alias("p"), F.lit(1).alias("s"), F.lit(0).alias("m")),
        test.select(F.lit(TEST_POPULATION).alias("p"), F.lit(1).alias("s"), F.lit(0).alias("m")),
        mart.select(F.col("source_population").alias("p"), F.lit(0).alias("s"), F.lit(1).alias("m")),
    ]
    return (
        reduce(DataFrame.unionByName, counts)
        .groupBy(F.col("p").alias("source_population"))
        .agg(F.sum("s").alias("staging_rows"), F.sum("m").alias("mart_rows"))
    )


def reconciliation_violations(train: DataFrame, test: DataFrame, mart: DataFrame) -> DataFrame:
    return (
        reconciliation(train, test, mart)
        .where(F.col("source_population").isin(TRAIN_POPULATION, TEST_POPULATION))
        .where("staging_rows <> mart_rows")
        .select(
            F.lit("staging rows differ from mart rows").alias("check"),
            F.concat_ws(
                "", "source_population", F.lit(": staging="), "staging_rows", F.lit(", mart="), "mart_rows"
            ).alias("detail"),
            F.abs(F.col("staging_rows") - F.col("mart_rows")).alias("n"),
        )
    )


def contract_violations(
    tables: Mapping[str, DataFrame], settings: Settings = Settings()
) -> DataFrame:
    """All violations of the staging, feature and mart contracts as one frame."""
    contracts = required_tables(settings.post_v1)
    missing = sorted(c.name for c in contracts if c.name not in tables)
    if missing:
        raise ContractError(f"Missing required tables: {', '.join(missing)}")
    found = schema_violations(tables, settings)
    mart = tables[MART]
    parts = [_facts(mart.sparkSession, found)]
    if not any(check == "mart is missing a required column" for check, _, _ in found):
        parts.append(mart_violations(mart, settings))
        parts.append(
            reconciliation_violations(
                tables["stg_application_train"], tables["stg_application_test"], mart
            )
        )
    aggregates = [c for c in contracts if c.name.startswith("f_") and c.grain == ("SK_ID_CURR",)]
    parts += [grain_violations(c.name, tables[c.name], c.grain) for c in aggregates]
    return reduce(DataFrame.unionByName, parts)


def require_contracts(tables: Mapping[str, DataFrame], settings: Settings = Settings()) -> None:
    """Raise one error if anything is wrong."""
    raise_violations(contract_violations(tables, settings), "The tables break their contracts")


def raise_violations(violations: DataFrame, lead: str) -> None:
    """Write every violation to a report table; the error has the counts of each check.

    A check's smallest detail is named as an example, so the message is bounded by the number
    of checks.
    """
    path = new_path(violations.sparkSession, "violations")
    violations.write.parquet(path)
    found = violations.sparkSession.read.parquet(path)
    checks = (
        found.groupBy("check")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("detail").alias("detail"))
        .orderBy("check")
        .collect()
    )
    if checks:
        total = sum(r["rows"] for r in checks)
        listed = "; ".join(
            f"{r['check']}: {r['detail']} ({r['n']} in {r['rows']})" for r in checks
        )
        raise ContractError(f"{lead}: {total} violations, all in {path}: {listed}")


def data_inventory(
    tables: Mapping[str, DataFrame], created_at: str, settings: Settings = Settings()
) -> DataFrame:
    parts = []
    for contract in required_tables(settings.post_v1):
        row = profile(contract.name, tables[contract.name], contract.grain)
        parts.append(
            row.withColumn("layer", F.lit(contract.layer))
            .withColumn("grain_key", F.lit(",".join(contract.grain)))
            .withColumnRenamed("duplicate_key_count", "duplicate_grain_key_count")
            .withColumn("created_at_utc", F.lit(created_at))
            .select(*REPORTS["data_inventory"])
        )
    return reduce(DataFrame.unionByName, parts)


def mart_profile(tables: Mapping[str, DataFrame], created_at: str) -> DataFrame:
    """Row, applicant, duplicate and column counts of every feature table."""
    parts = []
    for name, frame in tables.items():
        keys = [k for k in _POPULATION_GRAIN if k in frame.columns]
        row = profile(name, frame, keys).withColumn("created_at_utc", F.lit(created_at))
        parts.append(row.select(*REPORTS["feature_mart_profile"]))
    return reduce(DataFrame.unionByName, parts)


def feature_inventories(
    tables: Mapping[str, DataFrame], created_at: str, settings: Settings = Settings()
) -> DataFrame:
    """Column facts of the contracted feature tables, the diagnostics and the mart."""
    names = [c.name for c in required_tables(settings.post_v1) if c.layer != "staging"]
    parts = [
        feature_inventory(n, tables[n], settings, n == MART, created_at) for n in names
    ]
    return reduce(DataFrame.unionByName, parts)


SCORE_KEY = ("applicant_id", "scoring_population", "model_version", "threshold_version")


def score_violations(scores: DataFrame) -> DataFrame:
    """The score table must be non-empty, unique on its key and complete."""
    no_score = reduce(
        lambda a, b: a | b,
        (F.col(c).isNull() for c in ("score", "raw_risk_score", "calibrated_risk_score")),
    )
    no_band = F.col("risk_band").isNull() | F.col("recommended_action").isNull()
    table = "credit_risk_scores"
    checks = [
        ("score table is empty", table, F.when(F.count(F.lit(1)) == 0, 1).otherwise(0)),
        ("band or action is missing", table, F.count_if(no_band)),
        ("score is missing", table, F.count_if(no_score)),
    ]
    return _counted(scores, checks).unionByName(grain_violations(table, scores, SCORE_KEY))


def probability_violations(frame: DataFrame, name: str, detail: str) -> DataFrame:
    p = F.col(name)
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    return _counted(frame, [("probability outside [0, 1]", detail, F.count_if(bad))])


def selected_model_type(comparison: DataFrame, recomputed: str | None = None) -> str:
    """The one model type the comparison table selects; it must match a recomputed choice."""
    kinds = comparison.select("selected_model_type").distinct()
    row = kinds.agg(
        F.count(F.lit(1)).alias("n"),
        F.min("selected_model_type").alias("first"),
        F.max("selected_model_type").alias("last"),
    ).first()
    if row["n"] != 1 or row["first"] not in (BASELINE_TYPE, TREES_TYPE):
        raise ContractError(
            f"One supported model type must be selected, exactly one; there are {row['n']}, "
            f"from {row['first']} to {row['last']}"
        )
    if recomputed is not None and row["first"] != recomputed:
        raise ContractError(f"The saved selection {row['first']} differs from {recomputed}")
    return row["first"]


def balanced_policy(thresholds: DataFrame, version: str) -> tuple[str, float, float]:
    """(threshold_version, low, high) of the single validation/balanced row of a model."""
    row = (
        thresholds.where(
            (F.col("split") == "validation")
            & (F.col("scenario_name") == "balanced")
            & (F.col("model_version") == version)
        )
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(c).alias(c) for c in ("threshold_version", "threshold_low", "threshold_high")],
        )
        .first()
    )
    if row["n"] != 1:
        raise ContractError(
            f"{version} must have exactly one balanced row for validation, and has {row['n']}"
        )
    return row["threshold_version"], float(row["threshold_low"]), float(row["threshold_high"])


def require_same_surface(first: Mapping, second: Mapping) -> None:
    """Competing models must share their features."""
    if list(first["feature_columns"]) != list(second["feature_columns"]):
        raise ContractError("Models do not share the same feature columns")


def require_same_splits(first: DataFrame, second: DataFrame) -> None:
    """Competing models must share their splits: no (id, split) pair in only one of them."""
    pair = ["SK_ID_CURR", "split"]
    tagged = first.select(*pair, F.lit(1).alias("side")).unionByName(
        second.select(*pair, F.lit(-1).alias("side"))
    )
    if not tagged.groupBy(*pair).agg(F.sum("side").alias("d")).where("d <> 0").isEmpty():
        raise ContractError("Models do not share the same split assignments")
