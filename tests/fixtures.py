"""Three applicants over eight sources: long history, no history, zero income."""

from creditweave.schemas import SOURCES, staging_name

_ = None
ROWS = {
    "application_train": [
        (100001, 0, "Cash loans", "F", "N", "Y", 0, 100000.0, 200000.0, 10000.0, 150000.0,
         "Working", "Higher education", "Single / not married", "House / apartment", 0.02,
         -12000, -1000, -3000.0, -2500, _, "Laborers", 1.0, 2, 2, 10,
         "Business Entity Type 3", 0.10, 0.20, _, -500.0),
        (100002, 1, "Revolving loans", "M", "Y", "N", 2, 0.0, 50000.0, 5000.0, 40000.0,
         "Commercial associate", "Secondary / secondary special", "Married",
         "Rented apartment", 0.03, -16000, 365243, -1000.0, -1500, 5.0, "Managers", 4.0, 3, 3,
         11, "Self-employed", _, _, _, -100.0),
    ],
    "application_test": [
        (200001, "Cash loans", "F", "N", "Y", 1, 120000.0, 180000.0, 12000.0, 160000.0,
         "Pensioner", "Higher education", "Widow", "House / apartment", 0.04, -20000, -3000,
         -500.0, -4500, _, _, 2.0, 1, 1, 9, "XNA", 0.30, 0.40, 0.50, -30.0),
    ],
    "bureau": [
        (100001, 1, "Active", -100, 0, 300.0, _, 1000.0, 250.0, 100.0, 0.0),
        (100001, 2, "Closed", -400, 5, -10.0, -20.0, 2000.0, 0.0, 0.0, 50.0),
        (200001, 3, "Active", -50, 0, 500.0, _, 500.0, 100.0, 30.0, 0.0),
    ],
    "bureau_balance": [(1, 0, "0"), (1, -1, "1"), (1, -13, "2"), (2, -2, "C"), (2, -3, "X"), (3, 0, "5")],
    "previous_application": [
        (10, 100001, 1000.0, 800.0, "Approved", -20),
        (11, 100001, 2000.0, 2500.0, "Refused", -200),
        (12, 100002, 0.0, 100.0, "Canceled", -30),
    ],
    "pos_cash_balance": [
        (10, 100001, 0, 12.0, 10.0, "Active", 0, 0),
        (10, 100001, -1, 12.0, 9.0, "Active", 3, 1),
        (11, 100001, -13, 24.0, 0.0, "Completed", 0, 0),
        (11, 100001, -2, 24.0, 0.0, "Completed", 0, 0),
        (12, 100002, -4, 6.0, 4.0, "Demand", 7, 2),
        (20, 200001, 0, 10.0, 8.0, "Active", 0, 0),
    ],
    "credit_card_balance": [
        (30, 100001, 0, 100.0, 1000.0, 50.0, 20.0, 25.0, 25.0, 100.0, 1.0, "Active", 0, 0),
        (30, 100001, -1, 500.0, 1000.0, 100.0, 50.0, 25.0, 25.0, 500.0, 2.0, "Active", 5, 2),
        (31, 100001, -13, 0.0, 2000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "Completed", 0, 0),
        (31, 100001, -2, 200.0, 2000.0, 40.0, 10.0, 20.0, 20.0, 200.0, 1.0, "Completed", 0, 0),
        (32, 100002, -4, 300.0, 1500.0, 0.0, 30.0, 10.0, 10.0, 300.0, 0.0, "Demand", 4, 1),
        (40, 200001, 0, 250.0, 1000.0, 80.0, 25.0, 30.0, 30.0, 250.0, 1.0, "Active", 0, 0),
    ],
    "installments_payments": [
        (10, 100001, 1, -10.0, -8.0, 100.0, 90.0),
        (10, 100001, 2, -5.0, -7.0, 100.0, 100.0),
        (12, 100002, 1, -4.0, -1.0, 50.0, 25.0),
    ],
}

# Hand-computed mart values of applicant 100001.
GOLDEN = {
    "credit_to_income_ratio": 2.0, "annuity_to_income_ratio": 0.1, "ext_source_mean": 0.15,
    "ext_source_missing_count": 1, "bureau_credit_count": 2, "active_credit_count": 1,
    "overdue_credit_count": 1, "total_credit_sum": 3000.0, "bureau_balance_month_count": 5,
    "bureau_balance_bureau_count": 2, "bureau_balance_dpd_1plus_count": 2,
    "bureau_balance_dpd_2plus_count": 1, "bureau_balance_max_status": 2,
    "bureau_balance_dpd_1plus_rate": 0.4, "bureau_balance_recent_dpd_1plus_rate": 1 / 3,
    "pos_cash_month_count": 4, "pos_cash_contract_count": 2, "pos_cash_active_month_count": 2,
    "pos_cash_completed_month_count": 2, "pos_cash_dpd_month_count": 1,
    "pos_cash_dpd_def_month_count": 1, "pos_cash_max_dpd": 3, "pos_cash_dpd_month_rate": 0.25,
    "pos_cash_recent_dpd_month_rate": 1 / 3, "credit_card_month_count": 4,
    "credit_card_contract_count": 2, "credit_card_active_month_count": 2,
    "credit_card_completed_month_count": 2, "credit_card_dpd_month_count": 1,
    "credit_card_dpd_def_month_count": 1, "credit_card_max_dpd": 5,
    "credit_card_avg_balance": 200, "credit_card_max_balance": 500,
    "credit_card_avg_credit_limit": 1500, "credit_card_avg_credit_utilization": 0.175,
    "credit_card_payment_to_min_ratio": 0.875, "credit_card_recent_dpd_month_rate": 1 / 3,
    "bureau_balance_recent_dpd_rate_delta": -1 / 15, "bureau_balance_recent_status_delta": -0.5,
    "pos_cash_recent_dpd_rate_delta": 1 / 12,
    "pos_cash_remaining_installment_ratio_delta": 19 / 144,
    "credit_card_recent_utilization_delta": 7 / 120,
    "credit_card_recent_balance_ratio_delta": 1 / 3,
    "credit_card_recent_drawings_ratio_delta": 1 / 3,
    "credit_card_recent_dpd_rate_delta": 1 / 12, "installments_last_3_late_payment_rate": 1 / 2,
    "installments_last_3_underpayment_rate": 1 / 2,
    "installments_last_3_avg_payment_delay_days": 1,
    "installments_last_3_payment_amount_ratio": 0.95, "installments_last_payment_delay_days": 0,
    "installments_last_payment_ratio": 1, "pos_cash_last_3_dpd_rate": 1 / 3,
    "pos_cash_last_3_dpd_def_rate": 1 / 3, "pos_cash_last_3_future_installment_ratio": 19 / 48,
    "pos_cash_last_3_dpd_rate_delta": 1 / 12, "pos_cash_last_loan_dpd_rate": 1 / 2,
    "credit_card_last_3_credit_utilization": 7 / 30,
    "credit_card_last_3_payment_to_min_ratio": 0.875,
    "credit_card_last_3_drawing_count": 4 / 3, "credit_card_last_3_dpd_rate": 1 / 3,
    "credit_card_last_3_utilization_delta": 7 / 120, "external_score_credit_pressure": 1.7,
    "external_score_annuity_pressure": 0.085, "bureau_debt_to_income_ratio": 0.0025,
    "payment_shortfall_ratio": 0.05, "previous_application_count": 2,
    "approved_application_count": 1, "refused_application_count": 1, "approval_rate": 0.5,
    "avg_credit_to_application_ratio": 1.025, "installment_payment_count": 2,
    "late_payment_count": 1, "max_payment_delay_days": 2.0, "underpayment_count": 1,
    "payment_amount_ratio": 0.95,
}


def staging_frames(spark):
    return {
        staging_name(name): spark.createDataFrame(rows, SOURCES[name])
        for name, rows in ROWS.items()
    }


def synthetic_mart(spark, train=80, test=12):
    """A small mart whose columns are formulas of the row index."""
    rows = []
    for i in range(train + test):
        labeled = i < train
        rows.append((
            100000 + i if labeled else 200000 + i - train,
            "application_train" if labeled else "application_test",
            i % 2 if labeled else None,
            1 + i / 100, i % 5 + 1, i % 6 + 1, (i % 4) / 10, (i % 3) / 10, i % 8 + 1,
            (i % 5) / 10, (i % 4) / 10, i % 7 + 1, (i % 6) / 10, (i % 4) / 10,
            0.75 + (i % 7) / 20, i % 3 + 1, ("low", "medium", "high")[i % 3],
            None if i % 6 == 0 else i / 10,
        ))
    return spark.createDataFrame(
        rows,
        "SK_ID_CURR long, source_population string, TARGET long, credit_to_income_ratio double, "
        "bureau_credit_count long, bureau_balance_month_count long, "
        "bureau_balance_dpd_1plus_rate double, bureau_balance_recent_dpd_1plus_rate double, "
        "pos_cash_month_count long, pos_cash_dpd_month_rate double, "
        "pos_cash_recent_dpd_month_rate double, credit_card_month_count long, "
        "credit_card_avg_credit_utilization double, credit_card_dpd_month_rate double, "
        "payment_amount_ratio double, previous_application_count long, "
        "category_feature string, optional_numeric_feature double",
    )


def synthetic_diagnostics(spark, train=80, test=12):
    rows = [
        (100000 + i if i < train else 200000 + i - train,
         "application_train" if i < train else "application_test",
         i % 2 if i < train else None, "FM"[i % 2], "Married", 40, "30_to_44", 1, 2.0)
        for i in range(train + test)
    ]
    return spark.createDataFrame(
        rows,
        "SK_ID_CURR long, source_population string, TARGET long, CODE_GENDER string, "
        "NAME_FAMILY_STATUS string, applicant_age_years long, applicant_age_band string, "
        "CNT_CHILDREN long, CNT_FAM_MEMBERS double",
    )
