"""Header normalisation: statement tables, and customer or loan tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ratiowatch.functions import numbers, periods, text
from ratiowatch.functions.text import header_label_key, header_spaced_key
from ratiowatch.schema import (CREDIT_COLUMNS, FINANCIAL_COLUMNS, METRIC_LABELS, STATEMENT_HEADERS, TABLE_HEADERS)

C = F.col
BORROWER_KEYS = ("customer_id", "customer_ref", "client_id", "client_ref", "account_id", "loan_id", "customer_name")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def normalize_headers(frame: DataFrame) -> DataFrame:
    """Canonical names for known spellings; two columns for one name are an error."""
    renamed = {name: STATEMENT_HEADERS.get(header_spaced_key(name), name.strip()) for name in frame.columns}
    seen: set[str] = set()
    for canonical in renamed.values():
        if canonical in seen:
            raise ValueError(f"Several input columns mean {canonical!r}.")
        seen.add(canonical)
    return frame.select(*[_quoted(name).alias(canonical) for name, canonical in renamed.items()])


def normalize_table(frame: DataFrame) -> DataFrame:
    """Financial and credit headers with their units; repeated meanings keep the first value."""
    found: dict[str, list[Column]] = {}
    for field in frame.schema.fields:
        key = header_label_key(field.name)
        canonical = TABLE_HEADERS.get(key, field.name.strip())
        value = _quoted(field.name)
        if canonical in FINANCIAL_COLUMNS or canonical in ("credit_score", "loan_amount"):
            scale = numbers.header_unit_scale(field.name)
            if isinstance(field.dataType, T.NumericType):
                value = value.cast("double") * scale
            else:
                value = numbers.parse_scaled_amount(value, F.lit(scale))
            if canonical == "Sales_Growth" and "%" in field.name:
                value = value / 100
        found.setdefault(canonical, []).append(value)
    return frame.select(*[F.coalesce(*values).alias(name) for name, values in found.items()])


def table_kind(columns) -> str:
    names = set(columns)
    if names & set(BORROWER_KEYS):
        return "customer_loan_dataset"
    if names & set(FINANCIAL_COLUMNS):
        return "financial_credit_dataset"
    return "customer_loan_dataset" if names & set(CREDIT_COLUMNS) else "unknown_dataset"


def period_column(frame: DataFrame, name: str) -> Column:
    kind = frame.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return C(name).cast("date")
    if isinstance(kind, T.NumericType):
        return periods.year_end(C(name))
    return periods.parse_period(C(name))


def is_statement_layout(frame: DataFrame) -> bool:
    """Year columns, with an item column or a known label among all values of the first column."""
    import re

    keys = [header_label_key(name) for name in frame.columns]
    item = any(k in ("particulars", "particular", "line item", "financial item", "description", "account", "metric")
               for k in keys)
    years = any(re.search(periods.FISCAL_YEAR, name) for name in frame.columns)
    if not years or item:
        return years and item
    known = text.lookup(text.label_key(_quoted(frame.columns[0]).cast("string")), METRIC_LABELS).isNotNull()
    return bool(frame.agg(F.max(known)).first()[0])
