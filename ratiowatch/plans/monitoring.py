"""Named monitoring queries between revisions of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import features, monitoring
from ratiowatch.plans.records import screened
from ratiowatch.schema import MONITORED_FEATURES
from ratiowatch.session import cut_lineage, scratch_path
from ratiowatch.sources import driver

C = F.col


def revisions(spark, sf_dir):
    """Earlier and later half of the statements as two revisions of one dataset.

    Written once, because the stability index reads both sides more than once.
    """
    data = cut_lineage(features.engineer_features(driver.statements(spark, sf_dir)).select(
        "company_id", F.year("period").alias("year"), *MONITORED_FEATURES))
    return data.filter(C("year") <= 1998).drop("year"), data.filter(C("year") > 1998).drop("year")


def _book(spark, sf_dir):
    """Whole loans by the year they were made in."""
    return driver.loans(spark, sf_dir).withColumn("revision", F.year("origination_date"))


def q_snapshots(spark, sf_dir):
    return monitoring.snapshots(_book(spark, sf_dir), "revision")


def q_snapshot_distributions(spark, sf_dir):
    return monitoring.distributions(_book(spark, sf_dir), "revision", ["loan_amount", "credit_score"])


def q_stored_drift(spark, sf_dir):
    """The drift report from stored states."""
    folder = scratch_path(spark)
    base, latest = revisions(spark, sf_dir)
    for number, frame in enumerate((base, latest)):
        monitoring.save_snapshot(frame.withColumn("revision", F.lit(number)), "revision", folder)
    return monitoring.stored_drift(spark, folder, 0, 1).drop("place")


def q_psi(spark, sf_dir):
    return monitoring.psi(*revisions(spark, sf_dir), list(MONITORED_FEATURES)).drop("place")


def q_drift_report(spark, sf_dir):
    return monitoring.drift_report(*revisions(spark, sf_dir)).drop("place")


def scores(spark, sf_dir):
    return screened(spark, sf_dir).select(F.year("period").alias("revision"), "risk_index")


def q_prediction_stability(spark, sf_dir):
    return monitoring.prediction_stability(scores(spark, sf_dir), "revision")


def q_monitoring_alerts(spark, sf_dir):
    drift = monitoring.drift_report(*revisions(spark, sf_dir))
    return monitoring.monitoring_alerts(
        drift, monitoring.prediction_stability(scores(spark, sf_dir), "revision"), "revision")


QUERIES = {"snapshots": q_snapshots, "snapshot_distributions": q_snapshot_distributions, "stored_drift": q_stored_drift,
           "psi": q_psi, "drift_report": q_drift_report,
           "prediction_stability": q_prediction_stability, "monitoring_alerts": q_monitoring_alerts}
