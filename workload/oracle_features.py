"""DuckDB twins of the feature tables, written as one WITH chain per query."""

from __future__ import annotations

import re

from workload.staging import duckdb_staging

RECENT = "MONTHS_BALANCE >= -12"


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def per(n: str, d: str) -> str:
    return f"CAST({n} AS DOUBLE) / NULLIF(CAST({d} AS DOUBLE), 0)"


# name -> (expression, is it a double). Built per table, in output order.
APPLICANT = {
    **{c: (c, False) for c in ("NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY")},
    **{c: (c, True) for c in ("AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE")},
    "credit_to_income_ratio": (per("AMT_CREDIT", "AMT_INCOME_TOTAL"), True),
    "annuity_to_income_ratio": (per("AMT_ANNUITY", "AMT_INCOME_TOTAL"), True),
    "goods_price_to_income_ratio": (per("AMT_GOODS_PRICE", "AMT_INCOME_TOTAL"), True),
    **{c: (c, False) for c in ("NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE", "NAME_HOUSING_TYPE")},
    "REGION_POPULATION_RELATIVE": ("REGION_POPULATION_RELATIVE", True),
    "employment_length_days": ("CASE WHEN DAYS_EMPLOYED < 0 THEN -DAYS_EMPLOYED END", False),
    "DAYS_REGISTRATION": ("DAYS_REGISTRATION", True),
    "DAYS_ID_PUBLISH": ("DAYS_ID_PUBLISH", False),
    "OWN_CAR_AGE": ("OWN_CAR_AGE", True),
    **{
        c: (c, False)
        for c in (
            "OCCUPATION_TYPE",
            "REGION_RATING_CLIENT",
            "REGION_RATING_CLIENT_W_CITY",
            "HOUR_APPR_PROCESS_START",
            "ORGANIZATION_TYPE",
        )
    },
    **{f"EXT_SOURCE_{i}": (f"EXT_SOURCE_{i}", True) for i in (1, 2, 3)},
    "ext_source_mean": (
        "(coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0))"
        " / NULLIF((EXT_SOURCE_1 IS NOT NULL)::INT + (EXT_SOURCE_2 IS NOT NULL)::INT"
        " + (EXT_SOURCE_3 IS NOT NULL)::INT, 0)",
        True,
    ),
    "ext_source_min": ("least(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3)", True),
    "ext_source_max": ("greatest(EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3)", True),
    "ext_source_missing_count": (
        "(EXT_SOURCE_1 IS NULL)::INT + (EXT_SOURCE_2 IS NULL)::INT + (EXT_SOURCE_3 IS NULL)::INT",
        False,
    ),
    "DAYS_LAST_PHONE_CHANGE": ("DAYS_LAST_PHONE_CHANGE", True),
}

BUREAU = {
    "bureau_credit_count": ("count(*)", False),
    "active_credit_count": (n_if("lower(CREDIT_ACTIVE) = 'active'"), False),
    "closed_credit_count": (n_if("lower(CREDIT_ACTIVE) = 'closed'"), False),
    "overdue_credit_count": (n_if("CREDIT_DAY_OVERDUE > 0 OR AMT_CREDIT_SUM_OVERDUE > 0"), False),
    "max_credit_day_overdue": ("max(CREDIT_DAY_OVERDUE)", False),
    "total_credit_sum": ("sum(AMT_CREDIT_SUM)", True),
    "avg_credit_sum": ("avg(AMT_CREDIT_SUM)", True),
    "total_credit_debt": ("sum(AMT_CREDIT_SUM_DEBT)", True),
    "total_credit_limit": ("sum(AMT_CREDIT_SUM_LIMIT)", True),
    "total_credit_overdue": ("sum(AMT_CREDIT_SUM_OVERDUE)", True),
    "avg_days_credit": ("avg(DAYS_CREDIT)", True),
    "earliest_days_credit": ("min(DAYS_CREDIT)", False),
    "latest_days_credit": ("max(DAYS_CREDIT)", False),
    "avg_days_credit_enddate": ("avg(DAYS_CREDIT_ENDDATE)", True),
    "avg_days_enddate_fact": ("avg(DAYS_ENDDATE_FACT)", True),
}

_LATE, _KNOWN = f"{RECENT} AND num >= 1", f"{RECENT} AND code <> 'X'"
BALANCE = {
    f"bureau_balance_{k}": v
    for k, v in {
        "month_count": ("count(*)", False),
        "bureau_count": ("count(DISTINCT SK_ID_BUREAU)", False),
        "closed_month_count": (n_if("code = 'C'"), False),
        "unknown_month_count": (n_if("code = 'X'"), False),
        "dpd_0_count": (n_if("num = 0"), False),
        "dpd_1plus_count": (n_if("num >= 1"), False),
        "dpd_2plus_count": (n_if("num >= 2"), False),
        "dpd_5plus_count": (n_if("num >= 5"), False),
        "max_status": ("max(num)", False),
        "avg_numeric_status": ("avg(num)", True),
        "latest_month": ("max(MONTHS_BALANCE)", False),
        "earliest_month": ("min(MONTHS_BALANCE)", False),
        "recent_month_count": (n_if(RECENT), False),
        "recent_known_month_count": (n_if(_KNOWN), False),
        "recent_dpd_1plus_count": (n_if(_LATE), False),
        "dpd_1plus_rate": (per(n_if("num >= 1"), "count(*)"), True),
        "dpd_2plus_rate": (per(n_if("num >= 2"), "count(*)"), True),
        "recent_dpd_1plus_rate": (per(n_if(_LATE), n_if(_KNOWN)), True),
    }.items()
}
BALANCE_EXTRA = {
    "bureau_balance_recent_status_delta": (f"avg(num) FILTER (WHERE {RECENT}) - avg(num)", True)
}


def _status(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return n_if(f"lower(NAME_CONTRACT_STATUS) IN ({listed})")


PREVIOUS = {
    "previous_application_count": ("count(*)", False),
    "approved_application_count": (_status("approved"), False),
    "refused_application_count": (_status("refused"), False),
    "canceled_application_count": (_status("canceled"), False),
    "approval_rate": (per(_status("approved"), "count(*)"), True),
    "refusal_rate": (per(_status("refused"), "count(*)"), True),
    "avg_application_amount": ("avg(AMT_APPLICATION)", True),
    "avg_previous_credit_amount": ("avg(AMT_CREDIT)", True),
    "total_previous_credit_amount": ("sum(AMT_CREDIT)", True),
    "avg_credit_to_application_ratio": ("avg(AMT_CREDIT / NULLIF(AMT_APPLICATION, 0))", True),
    "avg_days_decision": ("avg(DAYS_DECISION)", True),
    "earliest_days_decision": ("min(DAYS_DECISION)", False),
    "latest_days_decision": ("max(DAYS_DECISION)", False),
}


def _months(prefix: str, problems: tuple[str, ...], middle: dict) -> dict:
    late = f"{RECENT} AND SK_DPD > 0"
    table = {
        "month_count": ("count(*)", False),
        "contract_count": ("count(DISTINCT SK_ID_PREV)", False),
        "active_month_count": (_status("active"), False),
        "completed_month_count": (_status("completed"), False),
        "problem_status_month_count": (_status(*problems), False),
        "dpd_month_count": (n_if("SK_DPD > 0"), False),
        "dpd_def_month_count": (n_if("SK_DPD_DEF > 0"), False),
        "max_dpd": ("max(SK_DPD)", False),
        "max_dpd_def": ("max(SK_DPD_DEF)", False),
        "avg_dpd": ("avg(SK_DPD)", True),
        "avg_dpd_def": ("avg(SK_DPD_DEF)", True),
        **middle,
        "latest_month": ("max(MONTHS_BALANCE)", False),
        "earliest_month": ("min(MONTHS_BALANCE)", False),
        "recent_month_count": (n_if(RECENT), False),
        "recent_dpd_month_count": (n_if(late), False),
        "completed_month_rate": (per(_status("completed"), "count(*)"), True),
        "dpd_month_rate": (per(n_if("SK_DPD > 0"), "count(*)"), True),
        "dpd_def_month_rate": (per(n_if("SK_DPD_DEF > 0"), "count(*)"), True),
        "recent_dpd_month_rate": (per(n_if(late), n_if(RECENT)), True),
    }
    return {f"{prefix}_{k}": v for k, v in table.items()}


POS = _months(
    "pos_cash",
    ("demand", "returned to the store", "amortized debt"),
    {
        "avg_instalment_count": ("avg(CNT_INSTALMENT)", True),
        "avg_future_installments": ("avg(CNT_INSTALMENT_FUTURE)", True),
    },
)
_UTIL = "AMT_BALANCE / NULLIF(AMT_CREDIT_LIMIT_ACTUAL, 0)"
CARD = _months(
    "credit_card",
    ("demand", "signed", "sent proposal", "refused"),
    {
        "avg_balance": ("avg(AMT_BALANCE)", True),
        "max_balance": ("max(AMT_BALANCE)", True),
        "avg_credit_limit": ("avg(AMT_CREDIT_LIMIT_ACTUAL)", True),
        "max_credit_limit": ("max(AMT_CREDIT_LIMIT_ACTUAL)", True),
        "balance_to_limit_ratio": (per("sum(AMT_BALANCE)", "sum(AMT_CREDIT_LIMIT_ACTUAL)"), True),
        "avg_credit_utilization": (f"avg({_UTIL})", True),
        "avg_drawings_current": ("avg(AMT_DRAWINGS_CURRENT)", True),
        "total_drawings_current": ("sum(AMT_DRAWINGS_CURRENT)", True),
        "avg_drawing_count": ("avg(CNT_DRAWINGS_CURRENT)", True),
        "total_drawing_count": ("sum(CNT_DRAWINGS_CURRENT)", True),
        "avg_total_receivable": ("avg(AMT_TOTAL_RECEIVABLE)", True),
        "total_receivable": ("sum(AMT_TOTAL_RECEIVABLE)", True),
        "payment_to_min_ratio": (per("sum(AMT_PAYMENT_CURRENT)", "sum(AMT_INST_MIN_REGULARITY)"), True),
        "total_payment_to_min_ratio": (
            per("sum(AMT_PAYMENT_TOTAL_CURRENT)", "sum(AMT_INST_MIN_REGULARITY)"),
            True,
        ),
    },
)
_DELAY = "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT"
INSTALLMENTS = {
    "installment_payment_count": ("count(*)", False),
    "late_payment_count": (n_if("DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT"), False),
    "avg_payment_delay_days": (f"avg({_DELAY})", True),
    "max_payment_delay_days": (f"max({_DELAY})", True),
    "underpayment_count": (n_if("AMT_PAYMENT < AMT_INSTALMENT"), False),
    "total_instalment_amount": ("sum(AMT_INSTALMENT)", True),
    "total_payment_amount": ("sum(AMT_PAYMENT)", True),
    "payment_amount_ratio": (per("sum(AMT_PAYMENT)", "sum(AMT_INSTALMENT)"), True),
    "avg_payment_to_instalment_ratio": ("avg(AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0))", True),
}
PRESSURE = {
    "external_score_credit_pressure": ("(1 - a.ext_source_mean) * a.credit_to_income_ratio", True),
    "external_score_annuity_pressure": ("(1 - a.ext_source_mean) * a.annuity_to_income_ratio", True),
    "bureau_debt_to_income_ratio": (per("b.total_credit_debt", "a.AMT_INCOME_TOTAL"), True),
    "payment_shortfall_ratio": (
        "CASE WHEN i.payment_amount_ratio IS NOT NULL THEN greatest(1 - i.payment_amount_ratio, 0) END",
        True,
    ),
}
RECENCY = {
    "bureau_balance_recent_dpd_rate_delta": (
        "bb.bureau_balance_recent_dpd_1plus_rate - bb.bureau_balance_dpd_1plus_rate",
        True,
    ),
    "bureau_balance_recent_status_delta": ("bb.bureau_balance_recent_status_delta", True),
    "pos_cash_recent_dpd_rate_delta": (
        "p.pos_cash_recent_dpd_month_rate - p.pos_cash_dpd_month_rate",
        True,
    ),
    "pos_cash_remaining_installment_ratio_delta": ("p.remaining_delta", True),
    "credit_card_recent_utilization_delta": ("c.utilization_delta", True),
    "credit_card_recent_balance_ratio_delta": ("c.balance_delta", True),
    "credit_card_recent_drawings_ratio_delta": ("c.drawings_delta", True),
    "credit_card_recent_dpd_rate_delta": (
        "c.credit_card_recent_dpd_month_rate - c.credit_card_dpd_month_rate",
        True,
    ),
}
LAST_K = {
    "installments_last_3_late_payment_rate": ("li.late_rate", True),
    "installments_last_3_underpayment_rate": ("li.under_rate", True),
    "installments_last_3_avg_payment_delay_days": ("li.delay", True),
    "installments_last_3_payment_amount_ratio": ("li.paid_ratio", True),
    "installments_last_payment_delay_days": ("l1.delay", True),
    "installments_last_payment_ratio": ("l1.paid_ratio", True),
    "pos_cash_last_3_dpd_rate": ("lp.dpd", True),
    "pos_cash_last_3_dpd_def_rate": ("lp.dpd_def", True),
    "pos_cash_last_3_future_installment_ratio": ("lp.future_ratio", True),
    "pos_cash_last_3_dpd_rate_delta": ("lp.dpd - p.pos_cash_dpd_month_rate", True),
    "pos_cash_last_loan_dpd_rate": ("ll.rate", True),
    "credit_card_last_3_credit_utilization": ("lc.utilization", True),
    "credit_card_last_3_payment_to_min_ratio": ("lc.paid_ratio", True),
    "credit_card_last_3_drawing_count": ("lc.drawings", True),
    "credit_card_last_3_dpd_rate": ("lc.dpd", True),
    "credit_card_last_3_utilization_delta": (
        "lc.utilization - c.credit_card_avg_credit_utilization",
        True,
    ),
}


def columns(table: dict) -> str:
    return ", ".join(f"{expression} AS {name}" for name, (expression, _) in table.items())


def round6(expression: str) -> str:
    return f"floor(({expression}) * 1000000 + 0.5) / 1000000"


def rounded(table: dict, alias: str = "") -> str:
    """Output columns of a computed table, doubles rounded like the Spark side."""
    dot = f"{alias}." if alias else ""
    return ", ".join(
        f"{round6(dot + name)} AS {name}" if double else f"{dot}{name}"
        for name, (_, double) in table.items()
    )


def _by_applicant(source: str, table: dict, extra: dict | None = None) -> str:
    return f"SELECT SK_ID_CURR, {columns({**table, **(extra or {})})} FROM {source} GROUP BY ALL"


_LATEST_INSTALLMENTS = """row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY DAYS_INSTALMENT DESC NULLS LAST,
  SK_ID_PREV DESC NULLS LAST, NUM_INSTALMENT_NUMBER DESC NULLS LAST, DAYS_ENTRY_PAYMENT DESC NULLS LAST,
  AMT_INSTALMENT DESC NULLS LAST, AMT_PAYMENT DESC NULLS LAST)"""
_LATEST_POS = """row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY MONTHS_BALANCE DESC NULLS LAST,
  SK_ID_PREV DESC NULLS LAST, CNT_INSTALMENT DESC NULLS LAST, CNT_INSTALMENT_FUTURE DESC NULLS LAST,
  SK_DPD DESC NULLS LAST, SK_DPD_DEF DESC NULLS LAST)"""
_LATEST_CARD = """row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY MONTHS_BALANCE DESC NULLS LAST,
  SK_ID_PREV DESC NULLS LAST, AMT_BALANCE DESC NULLS LAST, AMT_CREDIT_LIMIT_ACTUAL DESC NULLS LAST,
  AMT_INST_MIN_REGULARITY DESC NULLS LAST, AMT_PAYMENT_CURRENT DESC NULLS LAST,
  CNT_DRAWINGS_CURRENT DESC NULLS LAST, SK_DPD DESC NULLS LAST)"""

_APPLICATIONS = """SELECT * REPLACE (TARGET AS TARGET), 'application_train' AS source_population FROM stg_application_train
UNION ALL BY NAME SELECT *, CAST(NULL AS BIGINT) AS TARGET, 'application_test' AS source_population FROM stg_application_test"""

CTES = {
    **duckdb_staging(),
    "applications": _APPLICATIONS,
    "f_applicant": f"SELECT SK_ID_CURR, source_population, TARGET, {columns(APPLICANT)} FROM applications",
    "f_diagnostics": """SELECT SK_ID_CURR, source_population, TARGET, CODE_GENDER, NAME_FAMILY_STATUS,
  CASE WHEN DAYS_BIRTH < 0 THEN CAST(floor(-DAYS_BIRTH / 365.25) AS BIGINT) END AS applicant_age_years,
  CASE WHEN DAYS_BIRTH IS NULL THEN NULL WHEN floor(-DAYS_BIRTH / 365.25) >= 60 THEN '60_plus'
    WHEN floor(-DAYS_BIRTH / 365.25) >= 45 THEN '45_to_59' WHEN floor(-DAYS_BIRTH / 365.25) >= 30 THEN '30_to_44'
    ELSE 'under_30' END AS applicant_age_band, CNT_CHILDREN, CNT_FAM_MEMBERS FROM applications""",
    "f_bureau": _by_applicant("stg_bureau", BUREAU),
    "statuses": """SELECT b.SK_ID_CURR, s.SK_ID_BUREAU, s.MONTHS_BALANCE, upper(s.STATUS) AS code,
  CASE WHEN s.STATUS IN ('0','1','2','3','4','5') THEN CAST(s.STATUS AS INTEGER) END AS num
FROM stg_bureau_balance s JOIN stg_bureau b USING (SK_ID_BUREAU)""",
    "f_balance": _by_applicant("statuses", BALANCE, BALANCE_EXTRA),
    "f_previous": _by_applicant("stg_previous_application", PREVIOUS),
    "f_pos": _by_applicant("stg_pos_cash_balance", POS, {
        "remaining_delta": (
            per(f"sum(CASE WHEN {RECENT} THEN CNT_INSTALMENT_FUTURE ELSE 0 END)",
                f"sum(CASE WHEN {RECENT} THEN CNT_INSTALMENT ELSE 0 END)")
            + " - " + per("sum(CNT_INSTALMENT_FUTURE)", "sum(CNT_INSTALMENT)"), True),
    }),
    "f_card": _by_applicant("stg_credit_card_balance", CARD, {
        "utilization_delta": (f"avg({_UTIL}) FILTER (WHERE {RECENT}) - avg({_UTIL})", True),
        "balance_delta": (
            per(f"avg(AMT_BALANCE) FILTER (WHERE {RECENT})", "avg(AMT_BALANCE)") + " - 1", True),
        "drawings_delta": (
            per(f"avg(AMT_DRAWINGS_CURRENT) FILTER (WHERE {RECENT})", "avg(AMT_DRAWINGS_CURRENT)")
            + " - 1", True),
    }),
    "f_installments": _by_applicant("stg_installments_payments", INSTALLMENTS),
    "latest_inst": f"""SELECT *, {_LATEST_INSTALLMENTS} AS nth FROM stg_installments_payments QUALIFY nth <= 3""",
    "last_inst": f"""SELECT SK_ID_CURR, avg((coalesce({_DELAY} > 0, false))::INT) AS late_rate,
  avg((coalesce(AMT_PAYMENT < AMT_INSTALMENT, false))::INT) AS under_rate,
  avg(greatest(coalesce({_DELAY}, 0), 0)) AS delay, {per("sum(AMT_PAYMENT)", "sum(AMT_INSTALMENT)")} AS paid_ratio
FROM latest_inst GROUP BY ALL""",
    "last_inst1": f"""SELECT SK_ID_CURR, greatest(coalesce({_DELAY}, 0), 0) AS delay,
  AMT_PAYMENT / NULLIF(AMT_INSTALMENT, 0) AS paid_ratio FROM latest_inst WHERE nth = 1""",
    "last_pos": f"""SELECT SK_ID_CURR, avg((SK_DPD > 0)::INT) AS dpd, avg((SK_DPD_DEF > 0)::INT) AS dpd_def,
  {per("sum(CNT_INSTALMENT_FUTURE)", "sum(CNT_INSTALMENT)")} AS future_ratio
FROM (SELECT *, {_LATEST_POS} AS nth FROM stg_pos_cash_balance QUALIFY nth <= 3) GROUP BY ALL""",
    "last_loan": """SELECT m.SK_ID_CURR, l.SK_ID_PREV, avg((SK_DPD > 0)::INT) AS rate FROM stg_pos_cash_balance m
JOIN (SELECT SK_ID_CURR, SK_ID_PREV FROM (SELECT SK_ID_CURR, SK_ID_PREV, max(MONTHS_BALANCE) AS latest
  FROM stg_pos_cash_balance GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY latest DESC, SK_ID_PREV DESC) = 1) l
ON m.SK_ID_CURR = l.SK_ID_CURR AND m.SK_ID_PREV = l.SK_ID_PREV GROUP BY ALL""",
    "last_card": f"""SELECT SK_ID_CURR, avg({_UTIL}) AS utilization,
  {per("sum(AMT_PAYMENT_CURRENT)", "sum(AMT_INST_MIN_REGULARITY)")} AS paid_ratio,
  avg(CNT_DRAWINGS_CURRENT) AS drawings, avg((SK_DPD > 0)::INT) AS dpd
FROM (SELECT *, {_LATEST_CARD} AS nth FROM stg_credit_card_balance QUALIFY nth <= 3) GROUP BY ALL""",
    "f_pressure": f"""SELECT a.SK_ID_CURR, a.source_population, {columns(PRESSURE)} FROM f_applicant a
LEFT JOIN f_bureau b ON a.SK_ID_CURR = b.SK_ID_CURR LEFT JOIN f_installments i ON a.SK_ID_CURR = i.SK_ID_CURR""",
    "f_recency": f"""SELECT a.SK_ID_CURR, a.source_population, {columns(RECENCY)} FROM f_applicant a
LEFT JOIN f_balance bb ON a.SK_ID_CURR = bb.SK_ID_CURR LEFT JOIN f_pos p ON a.SK_ID_CURR = p.SK_ID_CURR
LEFT JOIN f_card c ON a.SK_ID_CURR = c.SK_ID_CURR""",
    "f_last_k": f"""SELECT a.SK_ID_CURR, a.source_population, {columns(LAST_K)} FROM f_applicant a
LEFT JOIN last_inst li ON a.SK_ID_CURR = li.SK_ID_CURR LEFT JOIN last_inst1 l1 ON a.SK_ID_CURR = l1.SK_ID_CURR
LEFT JOIN last_pos lp ON a.SK_ID_CURR = lp.SK_ID_CURR LEFT JOIN last_loan ll ON a.SK_ID_CURR = ll.SK_ID_CURR
LEFT JOIN f_pos p ON a.SK_ID_CURR = p.SK_ID_CURR LEFT JOIN last_card lc ON a.SK_ID_CURR = lc.SK_ID_CURR
LEFT JOIN f_card c ON a.SK_ID_CURR = c.SK_ID_CURR""",
}
V1 = {**APPLICANT, **BUREAU, **PREVIOUS, **INSTALLMENTS}
FULL = {
    **APPLICANT, **BUREAU, **BALANCE, **POS, **CARD, **RECENCY, **LAST_K,
    **PREVIOUS, **INSTALLMENTS, **PRESSURE,
}


def _mart(table: dict, joins: dict[str, tuple[dict, str]]) -> str:
    source = {name: alias for alias, (part, _) in joins.items() for name in part}
    chosen = ", ".join(f"{source.get(name, 'a')}.{name}" for name in table)
    chain = " ".join(f"LEFT JOIN {on.format(alias=alias)}" for alias, (_, on) in joins.items())
    return f"SELECT a.SK_ID_CURR, a.source_population, a.TARGET, {chosen} FROM f_applicant a {chain}"


def _on(table: str) -> str:
    return f"{table} {{alias}} ON a.SK_ID_CURR = {{alias}}.SK_ID_CURR"


def _on_both(table: str) -> str:
    return _on(table) + " AND a.source_population = {alias}.source_population"


_HISTORY = {
    "b": (BUREAU, _on("f_bureau")),
    "v": (PREVIOUS, _on("f_previous")),
    "i": (INSTALLMENTS, _on("f_installments")),
}
CTES["mart_v1"] = _mart(V1, _HISTORY)
CTES["mart"] = _mart(FULL, {
    **_HISTORY,
    "bb": (BALANCE, _on("f_balance")),
    "p": (POS, _on("f_pos")),
    "c": (CARD, _on("f_card")),
    "r": (RECENCY, _on_both("f_recency")),
    "k": (LAST_K, _on_both("f_last_k")),
    "x": (PRESSURE, _on_both("f_pressure")),
})


def compose(select: str, more: dict[str, str] | None = None) -> str:
    """The SELECT preceded by the named tables it needs, in dependency order."""
    known = {**CTES, **(more or {})}
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if name in known and name not in order:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(select)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + select


KEY = "SK_ID_CURR, source_population"


def feature_oracles() -> dict[str, str]:
    def table(cte: str, parts: dict, lead: str) -> str:
        return compose(f"SELECT {lead}, {rounded(parts)} FROM {cte}")

    return {
        "applicant_static": table("f_applicant", APPLICANT, f"{KEY}, TARGET"),
        "segment_diagnostics": compose("SELECT * FROM f_diagnostics"),
        "bureau_agg": table("f_bureau", BUREAU, "SK_ID_CURR"),
        "bureau_balance_agg": table("f_balance", BALANCE, "SK_ID_CURR"),
        "previous_agg": table("f_previous", PREVIOUS, "SK_ID_CURR"),
        "pos_agg": table("f_pos", POS, "SK_ID_CURR"),
        "card_agg": table("f_card", CARD, "SK_ID_CURR"),
        "installments_agg": table("f_installments", INSTALLMENTS, "SK_ID_CURR"),
        "risk_pressure": table("f_pressure", PRESSURE, KEY),
        "recency_delta": table("f_recency", RECENCY, KEY),
        "last_k": table("f_last_k", LAST_K, KEY),
        "latest_loan": compose(
            f"SELECT SK_ID_CURR, {round6('rate')} AS pos_cash_last_loan_dpd_rate FROM last_loan"
        ),
        "mart_v1": table("mart_v1", V1, f"{KEY}, TARGET"),
        "mart_full": table("mart", FULL, f"{KEY}, TARGET"),
    }
