"""Search, filter, sort and page over any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ratiowatch.functions.text import search_text
from ratiowatch.operators import ordered
from ratiowatch.operators.intel import low_cardinality

C = F.col
MAX_OPTIONS = 30


def search(frame: DataFrame, needle: str) -> DataFrame:
    """Rows whose joined text holds the needle; an empty needle keeps every row."""
    wanted = (needle or "").strip().lower()
    return frame.filter(search_text(frame).contains(wanted)) if wanted else frame


def filter_values(frame: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Rows inside every selection; null counts as "Missing", unknown columns are ignored."""
    kept = frame
    for name, values in allowed.items():
        if name in frame.columns and values:
            kept = kept.filter(F.coalesce(C(name).cast("string"), F.lit("Missing")).isin(*[str(v) for v in values]))
    return kept


def numeric_filter_columns(frame: DataFrame, most: int = 2) -> list[str]:
    numeric = [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)]
    seen = frame.agg(*[F.count(n).alias(n) for n in numeric]).first() if numeric else None
    numeric = [n for n in numeric if seen[n]]
    return ([n for n in numeric if "score" in n.lower()] or numeric)[:most]


def numeric_bounds(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or numeric_filter_columns(frame)
    wide = frame.agg(*[f(C(n).cast("double")).alias(f"{p}_{n}") for n in names for p, f in (("min", F.min), ("max", F.max))])
    return wide.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("variable"), F.coalesce(f"min_{n}", F.lit(0.0)).alias("low"),
        F.coalesce(f"max_{n}", F.lit(0.0)).alias("high")) for n in names])).alias("r")).select("r.*")


def filter_candidates(frame: DataFrame, most: int = MAX_OPTIONS) -> DataFrame:
    """Non-numeric columns with 2 to ``most`` values (null counts as one) and their values."""
    names = [f.name for f in frame.schema.fields if not isinstance(f.dataType, T.NumericType)]
    likely = low_cardinality(frame, names, most)
    text = frame.select(*[F.coalesce(C(n).cast("string"), F.lit("Missing")).alias(n) for n in likely])
    values = text.unpivot([], likely, "variable", "value").distinct()
    # At most a few dozen values per column remain after the sketch, so the list is short.
    grouped = values.groupBy("variable").agg(F.count(F.lit(1)).alias("options"), F.collect_set("value").alias("found"))
    fitting = grouped.filter((C("options") > 1) & (C("options") <= most))
    place = F.row_number().over(Window.orderBy(C("options").desc(), C("variable")))
    return fitting.select("variable", "options", F.array_join(F.array_sort("found"), ", ").alias("option_values"), place.alias("place"))


def sort_rows(frame: DataFrame, column: str, key: str, ascending: bool = True) -> DataFrame:
    """Nulls last in both directions; ties by the key."""
    order = C(column).asc_nulls_last() if ascending else C(column).desc_nulls_last()
    return frame.orderBy(order, C(key))


def page(frame: DataFrame, column: str, key: str, number: int, size: int, ascending: bool = True) -> DataFrame:
    """One page with its resolved number and the page count.

    Rows are numbered slice by slice, so no task keeps everything before the page.
    """
    size = max(1, int(size))
    total = frame.count()
    pages = max(1, -(-total // size))
    number = min(max(1, int(number or 1)), pages)
    start = (number - 1) * size
    order = [C(column).asc_nulls_last() if ascending else C(column).desc_nulls_last(), C(key)]
    rows = ordered.numbered(frame, order).filter((C("position") > start) & (C("position") <= start + size)).drop("position")
    return rows.withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def plot_sample(frame: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """A fixed-size sample that is the same on every run and partitioning."""
    place = F.md5(F.concat_ws(":", C(key).cast("string"), F.lit(str(seed))))
    return frame.orderBy(place, C(key)).limit(rows)
