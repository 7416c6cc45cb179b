"""DuckDB SQL that recomputes each query from the same parquet tables."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracles import (calibration, ingest, intel, modeling, monitoring, portfolio, profile,
                         records, scenarios, tables)

    merged: dict[str, str] = {}
    for module in (records, portfolio, intel, profile, scenarios, monitoring, calibration, ingest,
                   tables, modeling):
        merged.update(module.SQL)
    return merged
