"""Queries over the given tables, one per operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditweave.plans.mart import FeatureTables
from creditweave.sources.workspace import store
from workload.staging import spark_staging


def tidy(frame: DataFrame) -> DataFrame:
    """Doubles rounded to six decimals with the same arithmetic as the SQL twins."""
    return frame.select(
        *[
            (F.floor(F.col(f.name) * 1e6 + 0.5) / F.lit(1e6)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in frame.schema
        ]
    )


def tables(spark: SparkSession, sf_dir: str) -> FeatureTables:
    return FeatureTables(spark_staging(spark, sf_dir))


def joined_once(spark: SparkSession, sf_dir: str) -> FeatureTables:
    """The same tables over a written copy of the installments.

    That source is a join here, and each digest that reads it would shuffle both sides anew.
    """
    staging = spark_staging(spark, sf_dir)
    name = "stg_installments_payments"
    return FeatureTables({**staging, name: store(staging[name], name).frame})


_FEATURE_TABLES = {
    "applicant_static": lambda t: t.applicants,
    "segment_diagnostics": lambda t: t.diagnostics,
    "bureau_agg": lambda t: t.bureau,
    "bureau_balance_agg": lambda t: t.named()["f_bureau_balance_agg"],
    "previous_agg": lambda t: t.previous,
    "pos_agg": lambda t: t.named()["f_pos_cash_agg"],
    "card_agg": lambda t: t.named()["f_credit_card_agg"],
    "installments_agg": lambda t: t.installments,
    "risk_pressure": lambda t: t.risk_pressure,
    "recency_delta": lambda t: t.recency,
    "last_k": lambda t: t.last_k,
    "latest_loan": lambda t: t.pos.select("SK_ID_CURR", "pos_cash_last_loan_dpd_rate"),
    "mart_v1": lambda t: t.mart_v1,
}


def _feature_query(pick):
    return lambda spark, sf_dir: tidy(pick(tables(spark, sf_dir)))


def mart_full(spark, sf_dir):
    return tidy(joined_once(spark, sf_dir).mart_post_v1)


def feature_queries() -> dict:
    found = {name: _feature_query(pick) for name, pick in _FEATURE_TABLES.items()}
    return found | {"mart_full": mart_full}
