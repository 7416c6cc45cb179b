"""Reporting periods and cohort labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# How a fiscal year is written, and which other date layouts are read.
FISCAL_YEAR = r"(?i)(?<!\d)(?:FY\s*)?(20\d{2})(?:\s*[-/]\s*(\d{2,4}))?(?!\d)"
DAY_PREFIX = r"^(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
OTHER_DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy")
YEAR_DIGITS = r"\d{4}"
OTHER_DATE_SHAPE = r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}/\d{2}/\d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})$"


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return text.try_cast("date")


def year_end(year: Column) -> Column:
    """31 December of a whole year in 1900-2100."""
    number = year.try_cast("double")
    whole = (number == F.floor(number)) & number.between(1900, 2100)
    return F.when(whole, F.make_date(number.try_cast("int"), F.lit(12), F.lit(31)))


def _parts(text: Column) -> dict[str, Column]:
    """What the layouts extract, each by one pattern."""
    return {
        "text": text,
        "day": F.when(text.rlike(DAY_PREFIX), _day(
            F.regexp_extract(text, DAY_PREFIX, 1), F.regexp_extract(text, DAY_PREFIX, 2), F.regexp_extract(text, DAY_PREFIX, 3))),
        "start": F.regexp_extract(text, FISCAL_YEAR, 1).try_cast("int"),
        "token": F.regexp_extract(text, FISCAL_YEAR, 2),
    }


def _period_of(part) -> Column:
    """Date from the extracted parts: ISO day, fiscal range, single year, other layouts."""
    start, token = part("start"), part("token")
    number = token.try_cast("int")
    century = F.floor(start / 100).cast("int") * 100
    short = number < 100
    end = (F.when(short & (number + century < start), number + century + 100)
           .when(short, number + century).otherwise(number))
    as_month = (F.length(token) == 2) & number.between(1, 12) & (end != start + 1)
    fiscal = (
        F.when(number.isNull(), F.make_date(start, F.lit(12), F.lit(31)))
        .when(as_month, F.last_day(F.make_date(start, number, F.lit(1))))
        .when(end == start + 1, F.make_date(end, F.lit(3), F.lit(31)))
        .otherwise(F.make_date(end, F.lit(12), F.lit(31)))
    )
    # A failed format costs an exception, so only text shaped like a date is tried.
    other = F.coalesce(*[F.try_to_timestamp(part("text"), F.lit(fmt)).cast("date") for fmt in OTHER_DATE_FORMATS])
    return (F.when(part("day").isNotNull(), part("day")).when(start.isNotNull(), fiscal)
            .when(part("text").rlike(OTHER_DATE_SHAPE), other))


def parse_period(value: Column) -> Column:
    """Reporting date of a text. Every layout holds a four-digit year; most text does
    not, and stops at one test."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(YEAR_DIGITS), _period_of(_parts(text).__getitem__))


def parse_periods(array: Column) -> Column:
    """``parse_period`` over an array, extracting the parts of each element once."""
    parts = F.transform(array, lambda cell: F.when(cell.rlike(YEAR_DIGITS), F.named_struct(
        *[piece for name, value in _parts(F.trim(cell)).items() for piece in (F.lit(name), value)])))
    return F.transform(parts, lambda p: F.when(p.isNotNull(), _period_of(lambda name: p[name])))


def cohort_of_date(date: Column, freq: str = "year") -> Column:
    if freq == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string"))
    return F.year(date).cast("string")


def month_label(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
