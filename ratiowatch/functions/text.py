"""Text keys for values (Column expressions) and for header names (driver strings)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# What separates words in a key, and what brackets are dropped.
SPACED = r"[\s_\-]+"
NON_ALNUM = r"[^a-z0-9]+"
BRACKETED = r"\(.*?\)|\[.*?\]"


def spaced_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value.cast("string"))), SPACED, " ")


def alnum_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value.cast("string")), NON_ALNUM, " "))


def label_key(value: Column) -> Column:
    text = F.replace(F.lower(value.cast("string")), F.lit("&"), F.lit(" and "))
    bare = F.when(text.contains("(") | text.contains("["), F.regexp_replace(text, BRACKETED, " ")).otherwise(text)
    return F.trim(F.regexp_replace(bare, NON_ALNUM, " "))


def header_spaced_key(name: str) -> str:
    return re.sub(SPACED, " ", name.strip().lower())


def header_alnum_key(name: str) -> str:
    return re.sub(NON_ALNUM, " ", name.lower()).strip()


def header_label_key(name: str) -> str:
    return re.sub(NON_ALNUM, " ", re.sub(BRACKETED, " ", name.lower().replace("&", " and "))).strip()


def search_text(frame: DataFrame, columns: list[str] | None = None) -> Column:
    """Every cell of a row as one lower-case string; null cells are empty."""
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (columns or frame.columns)]
    return F.lower(F.concat_ws(" ", *cells))


def lookup(key: Column, mapping: dict) -> Column:
    """Vocabulary lookup by a literal map; null for an unknown key."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)
