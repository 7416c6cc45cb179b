"""Company-period records from partial rows: last or first known value, then derived totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ratiowatch.functions.ratios import sum_present
from ratiowatch.operators.features import complete_columns
from ratiowatch.schema import COMPONENT_COLUMNS, FINANCIAL_COLUMNS

C = F.col
KEYS = ("company_id", "period")


def last_known(frame: DataFrame, columns, order: str, keys=KEYS) -> DataFrame:
    """Latest non-null value per column, kept as one candidate per task before the shuffle."""
    return frame.groupBy(*keys).agg(*[
        F.max_by(c, F.when(C(c).isNotNull(), C(order))).alias(c) for c in columns])


def first_known(frame: DataFrame, columns, order: str, keys=KEYS) -> DataFrame:
    return frame.groupBy(*keys).agg(*[
        F.min_by(c, F.when(C(c).isNotNull(), C(order))).alias(c) for c in columns])


def derive_totals(frame: DataFrame) -> DataFrame:
    """Missing totals from the parts that are present."""
    return frame.withColumns({
        "Debt": F.coalesce(C("Debt"), sum_present(C("Short_Term_Debt"), C("Long_Term_Debt"))),
        "Current_Assets": F.coalesce(
            C("Current_Assets"), sum_present(C("Cash_Balance"), C("Accounts_Receivable"), C("Inventory"))),
        "Current_Liabilities": F.coalesce(
            C("Current_Liabilities"), sum_present(C("Accounts_Payable"), C("Short_Term_Debt"))),
    })


def merge_records(records: DataFrame, order: str) -> DataFrame:
    """One row per company and period from any number of partial rows."""
    columns = (*FINANCIAL_COLUMNS, *COMPONENT_COLUMNS)
    merged = last_known(complete_columns(records, columns), columns, order)
    return derive_totals(merged).select(*KEYS, *FINANCIAL_COLUMNS)


def metric_rows_to_records(rows: DataFrame, order: str) -> DataFrame:
    """(company_id, period, metric, value) rows to one merged record per company and period."""
    names = (*FINANCIAL_COLUMNS, *COMPONENT_COLUMNS)
    wide = rows.select(*KEYS, order, *[F.when(C("metric") == n, C("value")).alias(n) for n in names])
    return merge_records(wide, order)
