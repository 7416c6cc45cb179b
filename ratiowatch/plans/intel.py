"""Named queries of portfolio intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import intel
from ratiowatch.plans.records import screened
from ratiowatch.sources import driver


def q_entity_risk(spark, sf_dir):
    return intel.entity_risk(screened(spark, sf_dir))


def q_portfolio_mix(spark, sf_dir):
    return intel.portfolio_mix(screened(spark, sf_dir))


def q_segment_concentration(spark, sf_dir):
    return intel.segment_concentration(driver.loan_table(spark, sf_dir))


def q_geo_concentration(spark, sf_dir):
    return intel.geo_concentration(driver.loan_table(spark, sf_dir))


def q_anomaly_share(spark, sf_dir):
    book = driver.loan_table(spark, sf_dir)
    return intel.anomaly_share(book.withColumn("amount_outlier", (F.col("loan_amount") > 400000).cast("int")))


def q_risk_by_period(spark, sf_dir):
    return intel.risk_by_period(screened(spark, sf_dir))


QUERIES = {
    "entity_risk": q_entity_risk, "portfolio_mix": q_portfolio_mix,
    "segment_concentration": q_segment_concentration, "geo_concentration": q_geo_concentration,
    "anomaly_share": q_anomaly_share, "risk_by_period": q_risk_by_period,
}
