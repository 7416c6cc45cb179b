"""Messy text numbers to doubles."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ratiowatch.functions.text import lookup

# Suffix -> multiplier, and the patterns around an amount.
TRAILING_SCALES = {
    "thousand": 1e3, "k": 1e3, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5,
    "crore": 1e7, "crores": 1e7, "cr": 1e7, "million": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9,
}
TRAILING_SCALE = r"(?i)\s*(thousand|million|billion|lakhs?|lacs?|crores?|cr|mn|bn|k)\s*$"
CURRENCY_SIGNS = "[₹$€£]"
CURRENCY_WORDS = r"(?i)\b(?:rs\.?|inr\b|usd\b|eur\b|gbp\b)"
PLAIN_NUMBER = r"^[-+]?\d*\.?\d+([eE][-+]?\d+)?$"
UNIT_SCALES = ((r"\b(crores?|crs?)\b", 1e7), (r"\b(lakhs?|lacs?)\b", 1e5),
               (r"\bmillions?\b", 1e6), (r"\bthousands?\b", 1e3))
UNIT_WORDS = r"(?i)\b(crores?|crs?|lakhs?|lacs?|millions?|thousands?)\b"
ANY_UNIT = r"(?i)cr|la[ck]|million|thousand"
RUPEE_DOT = r"(?i)r[\s,]*s[\s,]*\."
UNIT_LINE = r"\b(amounts?|figures?|values?|financial statements?)\b"


def parse_amount(value: Column, percent_as_fraction: bool = False) -> Column:
    """Amounts in general tables. A percent sign is dropped unless asked otherwise.

    The blank words hold no digit, so they fail the number pattern like any other text.
    """
    text = F.trim(value.cast("string"))
    scale = F.coalesce(lookup(F.lower(F.regexp_extract(text, TRAILING_SCALE, 1)), TRAILING_SCALES), F.lit(1.0))
    body = F.regexp_replace(F.regexp_replace(text, TRAILING_SCALE, ""), CURRENCY_SIGNS, "")
    body = F.trim(F.regexp_replace(body, CURRENCY_WORDS + r"|[,%()]", ""))
    number = F.when(body.rlike(PLAIN_NUMBER), body.try_cast("double"))
    signed = F.when(text.startswith("(") & text.endswith(")"), -F.abs(number)).otherwise(number)
    if percent_as_fraction:
        signed = F.when(text.contains("%"), signed / 100).otherwise(signed)
    amount = signed * scale
    return F.when(F.when(text.rlike("[0-9]"), F.abs(amount)) < F.lit(float("inf")), amount)


def unit_scale(value: Column) -> Column:
    """Multiplier named anywhere in the text; 1 when no unit is named."""
    text = F.lower(F.coalesce(value.cast("string"), F.lit("")))
    pattern, factor = UNIT_SCALES[0]
    chain = F.when(text.rlike(pattern), F.lit(factor))
    for pattern, factor in UNIT_SCALES[1:]:
        chain = chain.when(text.rlike(pattern), F.lit(factor))
    return chain.otherwise(F.lit(1.0))


def header_unit_scale(name: str) -> float:
    return next((factor for pattern, factor in UNIT_SCALES if re.search(pattern, name.lower())), 1.0)


def parse_scaled_amount(value: Column, scale: Column) -> Column:
    """Amounts in statements: a unit in the cell beats the scale of its header.

    Text without a digit stops at the first test, and text without a unit at the second.
    """
    text = F.trim(value.cast("string"))
    has_unit = text.rlike(ANY_UNIT)
    own = F.when(has_unit, unit_scale(text)).otherwise(F.lit(1.0))
    stripped = F.when(has_unit, F.regexp_replace(text, UNIT_WORDS, "")).otherwise(text)
    body = F.regexp_replace(F.regexp_replace(stripped, RUPEE_DOT, ""), r"[^0-9.+\-]", "")
    number = body.try_cast("double") * F.coalesce(F.nullif(own, F.lit(1.0)), scale)
    bracketed = stripped.startswith("(") & stripped.endswith(")")
    return F.when(text.rlike("[0-9]"), F.when(bracketed, -number).otherwise(number))


def growth_fraction(value: Column) -> Column:
    number = parse_scaled_amount(value, F.lit(1.0))
    return F.when(value.cast("string").contains("%"), number / 100).otherwise(number)
