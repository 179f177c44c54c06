"""The eight credit sources derived from the given tables, as SQL for Spark and DuckDB.

Applicants are customers, bureau records and previous applications are orders, monthly
statuses and installments are line items, POS and card months are events. One text serves
both engines; only the day difference differs. Amounts are whole cents, so that their sums
are exact in both engines whatever the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_END = "2001-12-31"
EVENTS_END = "2024-01-31"


def _days(engine: str, column: str, end: str) -> str:
    """Days from a fixed end date: 0 on that day, negative before it."""
    if engine == "spark":
        return f"CAST(datediff(CAST({column} AS DATE), DATE '{end}') AS BIGINT)"
    return f"CAST(date_diff('day', DATE '{end}', CAST({column} AS DATE)) AS BIGINT)"


def _whole(expression: str) -> str:
    return f"CAST(CAST({expression} AS BIGINT) AS DOUBLE)"


def _cents(column: str) -> str:
    return _whole(f"round({column} * 100)")


def _dbl(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _application(where: str, target: bool) -> str:
    label = "CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS BIGINT) AS TARGET," if target else ""
    k = "c_custkey"
    return f"""SELECT {k} AS SK_ID_CURR, {label}
  CASE WHEN {k} % 10 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
  CASE WHEN {k} % 997 = 5 THEN 'XNA' WHEN {k} % 3 = 0 THEN 'M' ELSE 'F' END AS CODE_GENDER,
  CASE WHEN {k} % 2 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
  CASE WHEN {k} % 5 < 3 THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  {k} % 4 AS CNT_CHILDREN,
  {_dbl(f"CASE WHEN {k} % 53 = 0 THEN 0 WHEN {k} % 61 = 0 THEN NULL ELSE 20000 + {k} * 7919 % 180000 END")} AS AMT_INCOME_TOTAL,
  {_dbl(f"5000 + {k} * 104729 % 900000")} AS AMT_CREDIT,
  {_dbl(f"CASE WHEN {k} % 89 <> 0 THEN 500 + {k} * 611 % 40000 END")} AS AMT_ANNUITY,
  {_dbl(f"CASE WHEN {k} % 83 <> 0 THEN 4000 + {k} * 1301 % 800000 END")} AS AMT_GOODS_PRICE,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Working' WHEN 'MACHINERY' THEN 'State servant'
    WHEN 'HOUSEHOLD' THEN 'Pensioner' ELSE 'Commercial associate' END AS NAME_INCOME_TYPE,
  CASE c_nationkey % 4 WHEN 0 THEN 'Higher education' WHEN 1 THEN 'Incomplete higher'
    ELSE 'Secondary / secondary special' END AS NAME_EDUCATION_TYPE,
  CASE WHEN {k} % 71 = 0 THEN NULL WHEN {k} % 7 < 4 THEN 'Married' WHEN {k} % 7 < 6
    THEN 'Single / not married' ELSE 'Widow' END AS NAME_FAMILY_STATUS,
  CASE WHEN {k} % 6 = 0 THEN 'Rented apartment' ELSE 'House / apartment' END AS NAME_HOUSING_TYPE,
  (c_nationkey + 1) / {_dbl("1000")} AS REGION_POPULATION_RELATIVE,
  CASE WHEN {k} % 101 <> 0 THEN -(7500 + {k} * 37 % 18000) END AS DAYS_BIRTH,
  CASE WHEN {k} % 11 = 0 THEN 365243 ELSE -({k} * 13 % 12000) END AS DAYS_EMPLOYED,
  {_dbl(f"-({k} * 17 % 9000)")} AS DAYS_REGISTRATION,
  -({k} * 19 % 5000) AS DAYS_ID_PUBLISH,
  {_dbl(f"CASE WHEN {k} % 2 = 0 THEN {k} % 30 END")} AS OWN_CAR_AGE,
  CASE {k} % 4 WHEN 1 THEN 'Laborers' WHEN 2 THEN 'Managers' WHEN 3 THEN 'Sales staff' END AS OCCUPATION_TYPE,
  {_dbl(f"CASE WHEN {k} % 97 <> 0 THEN 1 + {k} % 5 END")} AS CNT_FAM_MEMBERS,
  CAST(1 + c_nationkey % 3 AS BIGINT) AS REGION_RATING_CLIENT,
  1 + (c_nationkey + {k}) % 3 AS REGION_RATING_CLIENT_W_CITY,
  {k} % 24 AS HOUR_APPR_PROCESS_START,
  c_mktsegment AS ORGANIZATION_TYPE,
  CASE WHEN {k} % 3 <> 0 THEN ({k} * 31 % 1000) / {_dbl("1000")} END AS EXT_SOURCE_1,
  CASE WHEN {k} % 50 <> 0 THEN ({k} * 57 % 1000) / {_dbl("1000")} END AS EXT_SOURCE_2,
  CASE WHEN {k} % 5 <> 0 THEN ({k} * 93 % 1000) / {_dbl("1000")} END AS EXT_SOURCE_3,
  {_dbl(f"-({k} * 23 % 3000)")} AS DAYS_LAST_PHONE_CHANGE
FROM {{customer}} WHERE {where}"""


def source_sql(engine: str) -> dict[str, str]:
    """Source name -> SELECT over {customer}, {orders}, {lineitem}, {events}."""
    placed = _days(engine, "o_orderdate", ORDERS_END)
    shipped = _days(engine, "l_shipdate", ORDERS_END)
    day = _days(engine, "ts", EVENTS_END)
    worth = _cents("value")
    return {
        "application_train": _application("c_custkey % 7 <> 0", True),
        "application_test": _application("c_custkey % 7 = 0", False),
        "bureau": f"""SELECT o_custkey AS SK_ID_CURR, o_orderkey AS SK_ID_BUREAU,
  CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'CLOSED' ELSE 'Sold' END AS CREDIT_ACTIVE,
  {placed} AS DAYS_CREDIT,
  CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 30 ELSE 0 END AS CREDIT_DAY_OVERDUE,
  {_dbl(f"CASE WHEN o_orderkey % 13 <> 0 THEN {placed} + o_orderkey % 900 END")} AS DAYS_CREDIT_ENDDATE,
  {_dbl(f"CASE WHEN o_orderstatus = 'F' THEN {placed} + o_orderkey % 400 END")} AS DAYS_ENDDATE_FACT,
  {_cents("o_totalprice")} AS AMT_CREDIT_SUM,
  CASE WHEN o_orderstatus = 'F' THEN {_dbl("0")}
    ELSE {_whole(f"floor({_cents('o_totalprice')} * (o_orderkey % 100) / 100)")} END AS AMT_CREDIT_SUM_DEBT,
  {_dbl("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 * 1000 END")} AS AMT_CREDIT_SUM_LIMIT,
  {_dbl("CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN o_orderkey % 5000 ELSE 0 END")} AS AMT_CREDIT_SUM_OVERDUE
FROM {{orders}}""",
        "bureau_balance": f"""SELECT l_orderkey AS SK_ID_BUREAU,
  CAST(floor({shipped} / {_dbl("30")}) AS BIGINT) AS MONTHS_BALANCE,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'C' WHEN l_returnflag = 'A' THEN 'x'
    WHEN l_returnflag = 'R' THEN CAST(l_linenumber % 6 AS STRING) ELSE '0' END AS STATUS
FROM {{lineitem}}""",
        "previous_application": f"""SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CASE WHEN o_orderkey % 17 = 0 THEN {_dbl("0")} WHEN o_orderkey % 19 <> 0 THEN {_cents("o_totalprice")} END AS AMT_APPLICATION,
  {_whole(f"floor({_cents('o_totalprice')} * (60 + o_orderkey % 70) / 100)")} AS AMT_CREDIT,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Approved' WHEN '2-HIGH' THEN 'Approved'
    WHEN '3-MEDIUM' THEN 'Canceled' WHEN '5-LOW' THEN 'Refused' ELSE 'Unused offer' END AS NAME_CONTRACT_STATUS,
  {placed} AS DAYS_DECISION
FROM {{orders}}""",
        "pos_cash_balance": f"""SELECT user_id * 10 + event_id % 7 AS SK_ID_PREV, user_id AS SK_ID_CURR,
  {day} AS MONTHS_BALANCE,
  {_dbl("CASE WHEN event_id % 43 <> 0 THEN 6 + event_id % 42 END")} AS CNT_INSTALMENT,
  {_dbl("CASE WHEN event_id % 41 <> 0 THEN event_id % 6 END")} AS CNT_INSTALMENT_FUTURE,
  CASE event_type WHEN 'error' THEN 'Demand' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'Signed'
    ELSE 'Active' END AS NAME_CONTRACT_STATUS,
  CASE WHEN event_type = 'error' THEN 1 + event_id % 60 ELSE 0 END AS SK_DPD,
  CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 + event_id % 20 ELSE 0 END AS SK_DPD_DEF
FROM {{events}}""",
        "credit_card_balance": f"""SELECT user_id * 10 + event_id % 3 AS SK_ID_PREV, user_id AS SK_ID_CURR,
  {day} AS MONTHS_BALANCE,
  {worth} AS AMT_BALANCE,
  {_dbl("CASE WHEN event_id % 29 = 0 THEN 0 WHEN user_id % 3 = 0 THEN 8192 WHEN user_id % 3 = 1 THEN 16384 ELSE 32768 END")} AS AMT_CREDIT_LIMIT_ACTUAL,
  CASE WHEN event_type = 'purchase' THEN {worth} ELSE {_dbl("0")} END AS AMT_DRAWINGS_CURRENT,
  {_whole(f"floor({worth} / 20)")} AS AMT_INST_MIN_REGULARITY,
  CASE WHEN event_id % 31 <> 0 THEN {_whole(f"floor({worth} * (event_id % 40) / 400)")} END AS AMT_PAYMENT_CURRENT,
  {_whole(f"floor({worth} * (event_id % 40) / 300)")} AS AMT_PAYMENT_TOTAL_CURRENT,
  {_whole(f"floor({worth} * 11 / 10)")} AS AMT_TOTAL_RECEIVABLE,
  {_dbl("CASE WHEN event_type = 'purchase' THEN 1 + event_id % 4 ELSE 0 END")} AS CNT_DRAWINGS_CURRENT,
  CASE event_type WHEN 'error' THEN 'Refused' WHEN 'purchase' THEN 'Active' WHEN 'signup' THEN 'Sent proposal'
    WHEN 'click' THEN 'Completed' ELSE 'active' END AS NAME_CONTRACT_STATUS,
  CASE WHEN event_type = 'error' THEN 1 + event_id % 45 ELSE 0 END AS SK_DPD,
  CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 1 + event_id % 9 ELSE 0 END AS SK_DPD_DEF
FROM {{events}}""",
        "installments_payments": f"""SELECT l_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CAST(l_linenumber AS BIGINT) AS NUM_INSTALMENT_NUMBER,
  {_dbl(placed)} AS DAYS_INSTALMENT,
  CASE WHEN l_partkey % 97 <> 0 THEN {_dbl(shipped)} END AS DAYS_ENTRY_PAYMENT,
  CASE WHEN l_partkey % 79 = 0 THEN {_dbl("0")} ELSE {_cents("l_extendedprice")} END AS AMT_INSTALMENT,
  {_whole(f"floor({_cents('l_extendedprice')} * (100 - round(l_discount * 100)) / 100)")} AS AMT_PAYMENT
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    }


_TABLES = ("customer", "orders", "lineitem", "events")


def spark_staging(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    staging = {}
    for name, text in source_sql("spark").items():
        used = {t: frame for t, frame in tables.items() if f"{{{t}}}" in text}
        staging[f"stg_{name}"] = spark.sql(text, **used)
    return staging


def duckdb_staging() -> dict[str, str]:
    names = {t: t for t in _TABLES}
    return {f"stg_{n}": text.format(**names) for n, text in source_sql("duckdb").items()}
