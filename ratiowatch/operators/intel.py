"""Portfolio intelligence: entity extremes, mix, concentration by segment and place, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ratiowatch.functions.text import header_spaced_key
from ratiowatch.session import cut_lineage

C = F.col

# Column names that mark an entity, a place and a period.
ENTITY_COLUMNS = ("company_id", "customer_id", "customer_name", "company", "borrower_id", "loan_id")
PLACE_NAMES = ("country", "state", "city", "region", "geography", "nation", "province", "district")
PERIOD_NAMES = ("period", "year", "date", "quarter", "month")
SKIPPED_SEGMENTS = ("company_id", "customer_id", "company")


def entity_column(frame: DataFrame) -> str | None:
    return next((name for name in ENTITY_COLUMNS if name in frame.columns), None)


def entity_risk(screened: DataFrame, entity: str = "company_id", rows: int = 10) -> DataFrame:
    """Mean index per entity: the riskiest and the strongest, each by a top-k. The means are written
    once, so the screening runs once for both ends."""
    means = cut_lineage(screened.groupBy(F.coalesce(C(entity).cast("string"), F.lit("Unknown")).alias("entity")).agg(
        F.round(F.avg("risk_index"), 6).alias("mean_risk")).filter(C("mean_risk").isNotNull()))

    def end(label, *order):
        top = means.orderBy(*order).limit(rows)
        return top.select(F.lit(label).alias("side"),
                          F.row_number().over(Window.orderBy(*order)).alias("place"), "entity", "mean_risk")

    return end("riskiest", C("mean_risk").desc(), C("entity")).unionByName(
        end("strongest", C("mean_risk").asc(), C("entity")))


def portfolio_mix(screened: DataFrame, entity: str = "company_id") -> DataFrame:
    """Tier counts, means and the largest entity; counted per entity first, then rolled up."""
    band = C("risk_category")
    per_entity = screened.groupBy(F.coalesce(C(entity).cast("string"), F.lit("Unknown")).alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.count("risk_index").alias("scored"),
        F.sum("risk_index").alias("risk"), F.sum("health_score").alias("health"),
        *[F.count_if(band == name).alias(alias) for alias, name in (
            ("low", "Low Risk"), ("moderate", "Moderate Risk"), ("high", "High Risk"),
            ("critical", "Critical Risk"), ("insufficient", "Insufficient Data"))])
    total = F.sum("n")
    return per_entity.agg(
        F.count(F.lit(1)).alias("entities"), total.alias("records"),
        F.round(F.try_divide(F.sum("risk"), F.sum("scored")), 6).alias("mean_risk"),
        F.round(F.try_divide(F.sum("health"), F.sum("scored")), 6).alias("mean_health"),
        (F.sum("high") / total).alias("high_share"), (F.max("n") / total).alias("largest_entity_share"),
        F.min_by("entity", F.struct(-C("n"), C("entity"))).alias("largest_entity"),
        *[F.sum(name).alias(f"{name}_records") for name in ("low", "moderate", "high", "critical", "insufficient")])


def value_counts(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, records) over non-null values of the listed columns."""
    text = frame.select(*[C(name).cast("string").alias(name) for name in columns])
    return text.unpivot([], columns, "variable", "value").filter(C("value").isNotNull()).groupBy(
        "variable", "value").agg(F.count(F.lit(1)).alias("records"))


def low_cardinality(frame: DataFrame, columns: list[str], most: int) -> list[str]:
    """Columns that may have at most ``most`` values. The sketch errs by a few percent, so
    the bar is set far above ``most`` and the exact test follows on the counts."""
    sketch = frame.agg(*[F.approx_count_distinct(C(name)).alias(name) for name in columns]).first()
    return [name for name in columns if sketch[name] <= 2 * most + 10]


def top_shares(frame: DataFrame, columns: list[str], rows: int = 5, fewest: int = 0, most: int | None = None) -> DataFrame:
    """The largest values of each column with their share of non-null rows.

    The rank filter is applied inside each task before the shuffle, and the totals are
    one row per column, so a column may have any number of values.
    """
    counts = value_counts(frame, columns)
    totals = counts.groupBy(C("variable").alias("total_variable")).agg(
        F.count(F.lit(1)).alias("values"), F.sum("records").alias("total"))
    place = F.row_number().over(Window.partitionBy("variable").orderBy(C("records").desc(), C("value")))
    top = counts.withColumn("place", place).filter(C("place") <= rows)
    joined = top.join(F.broadcast(totals), C("variable") == C("total_variable"))
    kept = (C("values") >= fewest) & (C("values") <= most if most else F.lit(True))
    return joined.filter(kept).select(
        "variable", "value", "records", (C("records") / C("total")).alias("share"), "place")


def segment_concentration(frame: DataFrame, columns_limit: int = 6) -> DataFrame:
    """Columns with 2 to 12 values: their five largest shares, first six such columns."""
    candidates = low_cardinality(frame, [c for c in frame.columns if c not in SKIPPED_SEGMENTS], 12)
    shares = top_shares(frame, candidates, 5, 2, 12)
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), C("variable"))
    numbered = shares.withColumn("column_place", F.dense_rank().over(Window.orderBy(order)))
    return numbered.filter(C("column_place") <= columns_limit).drop("column_place")


def geo_concentration(frame: DataFrame) -> DataFrame:
    places = [name for name in frame.columns if header_spaced_key(name) in PLACE_NAMES]
    if not places:
        raise ValueError("No location column was found.")
    return top_shares(frame, places, 5)


def anomaly_share(frame: DataFrame) -> DataFrame:
    column = next((name for name in frame.columns
                   if "anomal" in header_spaced_key(name) or "outlier" in header_spaced_key(name)), None)
    if column is None:
        raise ValueError("No anomaly column was found.")
    flagged = F.coalesce(C(column).cast("double"), F.lit(0.0)) != 0
    return frame.agg(F.lit(column).alias("column"), F.avg(flagged.cast("int")).alias("share"))


def risk_by_period(screened: DataFrame) -> DataFrame:
    column = next((name for name in screened.columns if header_spaced_key(name) in PERIOD_NAMES), None)
    if column is None:
        raise ValueError("No period column was found.")
    return screened.groupBy(C(column).cast("string").alias("period")).agg(
        F.round(F.avg("risk_index"), 6).alias("mean_risk"), F.count("risk_index").alias("records"))
