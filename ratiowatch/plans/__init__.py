"""The catalogue of named queries."""

from __future__ import annotations

import importlib

AREAS = ("records", "portfolio", "intel", "profile", "scenarios", "monitoring", "calibration",
         "ingest", "tables", "modeling")


def all_queries() -> dict:
    merged: dict = {}
    for area in AREAS:
        merged.update(importlib.import_module(f"ratiowatch.plans.{area}").QUERIES)
    return merged
