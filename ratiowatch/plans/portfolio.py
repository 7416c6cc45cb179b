"""Named queries over the loan book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.functions import status
from ratiowatch.operators import portfolio
from ratiowatch.sources import driver

C = F.col


def rows(spark, sf_dir):
    return portfolio.portfolio_risk(driver.loans(spark, sf_dir, places=False))


def q_portfolio_risk(spark, sf_dir):
    return rows(spark, sf_dir).select("loan_id", "customer_id", "credit_score", "observed_default",
                                      "portfolio_risk_category", "risk_basis")


def q_portfolio_summary(spark, sf_dir):
    return portfolio.portfolio_summary(rows(spark, sf_dir))


def q_concentration(spark, sf_dir):
    return portfolio.concentration(portfolio.borrower_exposure(driver.loans(spark, sf_dir, borrower=False)))


def q_top_exposures(spark, sf_dir):
    return portfolio.top_exposures(portfolio.borrower_exposure(driver.loans(spark, sf_dir, borrower=False)))


def q_exposure_by_band(spark, sf_dir):
    return portfolio.exposure_by_band(rows(spark, sf_dir))


def q_vintage_year(spark, sf_dir):
    return portfolio.vintages(driver.loans(spark, sf_dir, places=False))


def q_vintage_quarter(spark, sf_dir):
    return portfolio.vintages(driver.loans(spark, sf_dir, places=False), freq="quarter")


def q_portfolio_findings(spark, sf_dir):
    return portfolio.analyze(driver.loans(spark, sf_dir, places=False))["findings"]


def q_default_status(spark, sf_dir):
    book = driver.loans(spark, sf_dir, borrower=False)
    return book.select("loan_id", status.normalized_status(C("loan_status")).alias("status_text"),
                       status.observed_default(C("loan_status")).alias("observed_default"))


def q_risk_label(spark, sf_dir):
    book = driver.loans(spark, sf_dir, borrower=False)
    return book.select("loan_id", status.is_risk_label(C("risk_status")).alias("status_is_risk"),
                       status.is_risk_label(C("loan_status")).alias("loan_is_risk"))


def q_target_values(spark, sf_dir):
    words = F.when(C("loan_status") == "Default", "Default").when(C("loan_status") == "Fully Paid", "healthy") \
        .otherwise("No")
    return driver.loans(spark, sf_dir, borrower=False).select("loan_id", status.binary_target(words).alias("target"))


QUERIES = {
    "portfolio_risk": q_portfolio_risk, "portfolio_summary": q_portfolio_summary,
    "concentration": q_concentration, "top_exposures": q_top_exposures,
    "exposure_by_band": q_exposure_by_band, "vintage_year": q_vintage_year,
    "vintage_quarter": q_vintage_quarter, "portfolio_findings": q_portfolio_findings,
    "default_status": q_default_status, "risk_label": q_risk_label, "target_values": q_target_values,
}
