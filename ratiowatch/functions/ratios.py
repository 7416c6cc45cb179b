"""Numeric column expressions: finite guards, clipping, bounded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEAR_ZERO = 1e-9
RATIO_LIMIT = 100.0
DAY_LIMIT = 3650.0


def finite(value: Column) -> Column:
    """Anything that is not a finite number becomes null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null: Spark's ``greatest``/``least`` would otherwise return the bound."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(F.abs(denominator) > NEAR_ZERO, F.try_divide(numerator, denominator))


def bounded_ratio(numerator: Column, denominator: Column) -> Column:
    return clip(safe_ratio(numerator, denominator), -RATIO_LIMIT, RATIO_LIMIT)


def day_ratio(numerator: Column, revenue: Column) -> Column:
    return clip(safe_ratio(numerator, revenue) * 365, 0.0, DAY_LIMIT)


def nonzero_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio over every non-zero denominator, however small."""
    return F.try_divide(numerator, denominator)


def count_true(*conditions: Column) -> Column:
    total = F.lit(0)
    for condition in conditions:
        total = total + F.coalesce(condition, F.lit(False)).cast("int")
    return total


def present_count(columns: list[Column]) -> Column:
    return count_true(*[column.isNotNull() for column in columns]).cast("bigint")


def sum_present(*columns: Column) -> Column:
    """Sum of the non-null parts; null when every part is null."""
    total = F.lit(0.0)
    for column in columns:
        total = total + F.coalesce(column, F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def percent_change(latest: Column, first: Column) -> Column:
    return F.try_divide(latest - first, F.abs(first)) * 100


def direction(latest: Column, first: Column) -> Column:
    return (F.when(latest > first, "Increasing").when(latest < first, "Declining")
            .when(latest == first, "Stable"))
