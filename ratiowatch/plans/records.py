"""Named queries over company-period statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import assessment, features, screening
from ratiowatch.operators.ordered import prior_values
from ratiowatch.schema import MODEL_FEATURES
from ratiowatch.sources import driver

C = F.col
KEYS = ("record_id", "company_id", "period")


def screened(spark, sf_dir):
    return features.screen(driver.statements(spark, sf_dir))


def _join(name, alias=None):
    return F.array_join(name, ", ").alias(alias or name)


def q_features(spark, sf_dir):
    return features.engineer_features(driver.statements(spark, sf_dir)).select(*KEYS, *MODEL_FEATURES)


def q_early_warnings(spark, sf_dir):
    flagged = features.early_warnings(features.engineer_features(driver.statements(spark, sf_dir)))
    return flagged.select(*KEYS, *features.FLAGS.values(), _join("warnings"), "warning_signals")


def q_risk_index(spark, sf_dir):
    scored = features.risk_index(features.engineer_features(driver.statements(spark, sf_dir)))
    return scored.select(*KEYS, "debt_equity_used", F.round("rule_risk_score", 4).alias("rule_risk_score"),
                         "risk_index", "risk_category", _join("risk_drivers"),
                         F.size("risk_drivers").cast("bigint").alias("risk_factors"),
                         F.size("protective_factors").cast("bigint").alias("protective_count"),
                         "observed_core_fields")


def q_screening(spark, sf_dir):
    return screened(spark, sf_dir).select(
        *KEYS, "method", "risk_index", "risk_category", "health_score", "data_coverage",
        F.round("coverage_percent", 0).cast("bigint").alias("coverage_percent"),
        "warning_signals", _join("warnings"), _join("risk_drivers", "drivers"))


def q_screening_summary(spark, sf_dir):
    return screening.screening_summary(screened(spark, sf_dir))


def q_screening_ranked(spark, sf_dir):
    return screening.ranked(screened(spark, sf_dir), 100).select(
        *KEYS, "risk_category", "risk_index", "health_score", "method", "warning_signals")


def q_banded_exposure(spark, sf_dir):
    return screening.banded_exposure(screened(spark, sf_dir), "Debt")


def q_extended_ratios(spark, sf_dir):
    rows = assessment.extended_ratios(screened(spark, sf_dir))
    return rows.select(*KEYS, "Current_Ratio", "Quick_Ratio", "debt_equity_ratio", "return_on_equity",
                       "return_on_assets", "working_capital", "equity", "cash_flow_to_revenue", "roce",
                       "gross_profit", "gross_margin", "Sales_Growth", "coverage_count",
                       _join("available_fields"), _join("missing_fields"))


def q_assessment(spark, sf_dir):
    return assessment.assess(screened(spark, sf_dir)).select(
        *KEYS, "risk_index", "risk_category", "coverage_label",
        C("driver_text").alias("top_risk_factors"), _join("protective_factors"))


def q_record_detail(spark, sf_dir):
    rows = assessment.extended_ratios(assessment.assess(screened(spark, sf_dir)))
    return rows.select(*KEYS, "method", "risk_index", "risk_category", "health_score", "coverage_label",
                       "driver_text", _join("warnings"), "Current_Ratio", "Debt_to_Assets", "EBITDA_Margin",
                       "Interest_Coverage", "equity", "roce", "gross_margin")


def q_warning_details(spark, sf_dir):
    return assessment.warning_details(screened(spark, sf_dir)).orderBy(
        "record_id", "severity_rank", "indicator")


def q_warnings_triggered(spark, sf_dir):
    return assessment.triggered(assessment.warning_details(screened(spark, sf_dir))).select(
        "record_id", "indicator", "severity")


def q_severity_counts(spark, sf_dir):
    return assessment.severity_counts(assessment.warning_details(screened(spark, sf_dir)))


def q_recommendations(spark, sf_dir):
    return assessment.recommendations(screened(spark, sf_dir)).select(
        *KEYS, F.array_join("recommendations", " | ").alias("recommendations"))


def q_risk_narrative(spark, sf_dir):
    return assessment.narrative(screened(spark, sf_dir)).select(
        *KEYS, _join("concerns"), _join("strengths"), "priority")


def q_credit_context(spark, sf_dir):
    return assessment.credit_context(screened(spark, sf_dir))


def q_prior_period(spark, sf_dir):
    change = F.when(C("prior_Revenue") != 0, (C("Revenue") - C("prior_Revenue")) / F.abs(C("prior_Revenue")))
    return features.engineer_features(driver.statements(spark, sf_dir)).select(
        *KEYS, "prior_period", C("prior_Revenue").alias("prior_revenue"), change.alias("revenue_change"))


def q_prior_loan(spark, sf_dir):
    """Previous loan of the same borrower, with no bound on the loans of a borrower."""
    book = driver.table(spark, sf_dir, "orders").select(
        C("o_custkey").alias("customer_id"), C("o_orderdate").cast("date").alias("loan_date"),
        C("o_orderkey").alias("loan_id"), C("o_totalprice").alias("loan_amount"))
    return prior_values(book, "customer_id", ["loan_date", "loan_id"], ["loan_date", "loan_amount"])


def q_company_trend(spark, sf_dir):
    return features.engineer_features(driver.statements(spark, sf_dir)).select(
        "company_id", "period", "Revenue", "Current_Ratio", "Debt_to_Assets", "EBITDA_Margin",
        "Interest_Coverage")


def q_company_options(spark, sf_dir):
    return driver.statements(spark, sf_dir).groupBy("company_id").agg(
        F.min("record_id").alias("first_record"), F.count(F.lit(1)).alias("periods"))


def q_coverage(spark, sf_dir):
    return screened(spark, sf_dir).select(
        "record_id", "observed_core_fields", F.round("coverage_percent", 6).alias("coverage_percent"))


def q_model_eligible(spark, sf_dir):
    data = features.complete_columns(driver.statements(spark, sf_dir))
    return data.select("record_id", features.model_eligible().alias("eligible"))


def q_validated_statements(spark, sf_dir):
    return features.validate_statements(driver.statements(spark, sf_dir)).select(
        *KEYS, "Revenue", "EBITDA", "Debt")


QUERIES = {
    "screening": q_screening, "features": q_features, "early_warnings": q_early_warnings,
    "risk_index": q_risk_index, "screening_summary": q_screening_summary,
    "screening_ranked": q_screening_ranked, "banded_exposure": q_banded_exposure,
    "extended_ratios": q_extended_ratios, "assessment": q_assessment, "record_detail": q_record_detail,
    "warning_details": q_warning_details, "warnings_triggered": q_warnings_triggered,
    "severity_counts": q_severity_counts, "recommendations": q_recommendations,
    "risk_narrative": q_risk_narrative, "credit_context": q_credit_context, "prior_period": q_prior_period,
    "prior_loan": q_prior_loan, "company_trend": q_company_trend, "company_options": q_company_options,
    "coverage": q_coverage, "model_eligible": q_model_eligible,
    "validated_statements": q_validated_statements,
}
