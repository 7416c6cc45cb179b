"""Named calibration queries over the scored loan book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import calibration
from ratiowatch.plans.records import screened
from ratiowatch.sources import driver

C = F.col
TUNED = (0.15, 0.35, 0.60)


def pairs(spark, sf_dir):
    return calibration.valid_pairs(driver.scored_pairs(spark, sf_dir))


def q_scored_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("loan_id", "p", "y")


def q_calibration_table(spark, sf_dir):
    return calibration.calibration_table(pairs(spark, sf_dir))


def q_reliability(spark, sf_dir):
    return calibration.reliability(pairs(spark, sf_dir))


def q_threshold_table(spark, sf_dir):
    return calibration.threshold_table(pairs(spark, sf_dir))


def q_band_distribution(spark, sf_dir):
    return calibration.band_distribution(screened(spark, sf_dir), C("risk_index") / 100)


def q_band_shift(spark, sf_dir):
    return calibration.band_shift(pairs(spark, sf_dir), C("p"), TUNED)


def q_binary_metrics(spark, sf_dir):
    return calibration.binary_metrics(pairs(spark, sf_dir))


def q_fairness(spark, sf_dir):
    return calibration.fairness(pairs(spark, sf_dir), "segment")


def q_calibration_slope(spark, sf_dir):
    return calibration.calibration_slope(pairs(spark, sf_dir))


QUERIES = {
    "scored_pairs": q_scored_pairs, "calibration_table": q_calibration_table, "reliability": q_reliability,
    "threshold_table": q_threshold_table, "band_distribution": q_band_distribution, "band_shift": q_band_shift,
    "binary_metrics": q_binary_metrics, "fairness": q_fairness, "calibration_slope": q_calibration_slope,
}
