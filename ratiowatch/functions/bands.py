"""Risk bands, drift labels and severity labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INSUFFICIENT = "Insufficient Data"
DEFAULT_CUTOFFS = (0.20, 0.40, 0.70)
BAND_ORDER = ("Low Risk", "Moderate Risk", "High Risk", "Critical Risk", INSUFFICIENT)
ELEVATED_INDEX = 60.0


def risk_band3(fraction: Column) -> Column:
    """Three bands used for record scores."""
    return (F.when(fraction.isNull(), INSUFFICIENT).when(fraction < 0.25, "Low Risk")
            .when(fraction < 0.60, "Moderate Risk").otherwise("High Risk"))


def risk_band4(fraction: Column, cutoffs=DEFAULT_CUTOFFS) -> Column:
    """Four bands used for scenarios and calibration; cutoffs are parameters."""
    moderate, high, critical = cutoffs
    return (F.when(fraction.isNull(), INSUFFICIENT).when(fraction >= critical, "Critical Risk")
            .when(fraction >= high, "High Risk").when(fraction >= moderate, "Moderate Risk")
            .otherwise("Low Risk"))


def index_band4(index: Column, cutoffs=DEFAULT_CUTOFFS) -> Column:
    """Same bands for a 0-100 index, comparing in points."""
    moderate, high, critical = (cutoff * 100 for cutoff in cutoffs)
    return (F.when(index.isNull(), INSUFFICIENT).when(index >= critical, "Critical Risk")
            .when(index >= high, "High Risk").when(index >= moderate, "Moderate Risk")
            .otherwise("Low Risk"))


def psi_label(value: Column) -> Column:
    return (F.when(value.isNull(), "Not comparable").when(value >= 0.25, "Significant shift")
            .when(value >= 0.10, "Watch").otherwise("Stable"))
