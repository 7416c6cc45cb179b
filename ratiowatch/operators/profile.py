"""Profile of any table: columns, quality, distributions, relations, trends, findings.

Functions take the ``TableShape`` found by ``typing_rules.inspect`` and return small
DataFrames. Every value that grows with the data is computed by Spark; the driver only
holds a few facts per column.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ratiowatch.functions import periods, ratios, status
from ratiowatch.operators import advice, ordered
from ratiowatch.operators.brackets import order_statistics
from ratiowatch.operators.quantiles import exact_median, to_long
from ratiowatch.operators.sketches import MISSING, frequent_values, long_values
from ratiowatch.operators.typing_rules import TableShape, ranked_numeric
from ratiowatch.functions.text import header_alnum_key
from ratiowatch.session import cut_lineage

C = F.col
SAMPLE_PROBE_ROWS = 200


def _listed(shape: TableShape, names: list[str], column: str = "variable") -> DataFrame:
    """One row per column name with its place, to keep columns without values in a result."""
    rows = [(name, place) for place, name in enumerate(names)]
    return shape.data.sparkSession.createDataFrame(rows, f"{column} string, place int")


def sample_values(shape: TableShape, key: str, values: int = 3) -> dict[str, list[str]]:
    """First non-null values by lowest key: a top-k read, repeated only for sparse columns."""
    names = shape.data.columns
    head = shape.source.orderBy(key).limit(SAMPLE_PROBE_ROWS).select(
        *[C(n).cast("string").alias(n) for n in names]).collect()
    found = {n: [row[n] for row in head if row[n] is not None][:values] for n in names}
    for name in names:
        if len(found[name]) < min(values, shape.rows - shape.missing[name]):
            rows = shape.source.filter(C(name).isNotNull()).orderBy(key).limit(values)
            found[name] = [r[0] for r in rows.select(C(name).cast("string")).collect()]
    return found


def column_profile(shape: TableShape, key: str) -> DataFrame:
    samples, identifiers = sample_values(shape, key), shape.identifiers
    shape.distinct.settle(shape.data.columns)
    rows = []
    for name in shape.data.columns:
        meaning = ", ".join(shape.roles[name]) or ("Potential ID" if name in identifiers else "")
        rows.append((name, shape.kinds[name], shape.missing[name], shape.missing[name] * 100.0 / max(shape.rows, 1),
                     shape.distinct[name], ", ".join(samples[name]), meaning))
    table = shape.data.sparkSession.createDataFrame(
        rows, "variable string, kind string, missing bigint, missing_percent double, distinct_values bigint, "
              "sample_values string, meaning string")
    return table.withColumn("missing_percent", F.round("missing_percent", 6))


def dataset_quality(shape: TableShape) -> DataFrame:
    """Missing-cell rate, quality and duplicate rows; equal rows fold before the shuffle."""
    names = shape.data.columns
    missing = F.lit(0)
    for name in names:
        missing = missing + C(name).isNull().cast("int")
    folded = shape.data.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    totals = folded.agg(F.sum("copies").alias("n_rows"), F.sum(missing * C("copies")).alias("cells"),
                        F.sum(C("copies") - 1).alias("duplicate_rows"))
    share = C("cells") * 100.0 / (C("n_rows") * len(names))
    return totals.select("n_rows", F.lit(len(names)).cast("bigint").alias("n_columns"),
                         F.round(share, 6).alias("missing_percent"),
                         F.round(F.lit(100.0) - share, 6).alias("quality_percent"), "duplicate_rows")


#: The percentiles that summaries show.
MARKS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _moments(value: Column) -> dict[str, Column]:
    return {"mean": F.avg(value), "std": F.when(F.count(value) > 1, F.stddev_samp(value)), "min": F.min(value), "max": F.max(value)}


def numeric_summary(shape: TableShape) -> DataFrame:
    """Count, moments, ends and exact percentiles per numeric column, from two readings of the table."""
    known = order_statistics(shape.data, {n: C(n) for n in shape.numeric}, MARKS, _moments)
    rows = [(n, k.n, *[k.facts[f] for f in ("mean", "std", "min")], *[k.values[m] for m in MARKS], k.facts["max"]) for n, k in known.items()]
    table = shape.data.sparkSession.createDataFrame(
        rows, "variable string, n bigint, mean double, std double, min double, " + ", ".join(f"{m} double" for m in MARKS) + ", max double")
    return table.select("variable", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min",
                        *[F.round(m, 6).alias(m) for m in MARKS], "max")


def top_values(shape: TableShape, columns: list[str], most: int) -> DataFrame:
    """Most frequent values per column, null as "Missing", by count and then value.

    Sketches name the candidates, which are counted; only columns whose last places stay
    open are counted whole. There the rank filter runs inside each task before the shuffle.
    """
    settled, rest = frequent_values(shape.data, columns, most, shape.rows)
    rows = [(n, value, count, place) for n, found in settled.items() for place, (value, count) in enumerate(found, 1)]
    table = shape.data.sparkSession.createDataFrame(rows, "variable string, value string, records bigint, place int")
    if not rest:
        return table
    counts = long_values(shape.data, rest).withColumn("value", F.coalesce("value", F.lit(MISSING))).groupBy(
        "variable", "value").agg(F.sum("records").alias("records"))
    place = F.row_number().over(Window.partitionBy("variable").orderBy(C("records").desc(), C("value")))
    return table.unionByName(counts.withColumn("place", place).filter(C("place") <= most))


def categorical_summary(shape: TableShape, most: int = 10) -> DataFrame:
    return top_values(shape, shape.categorical, most).select(
        "variable", "value", "records", F.round(C("records") * 100.0 / shape.rows, 6).alias("share_percent"))


def _pair_moments(columns: list[str], centers: list[float]):
    """Partial sums for every pair of columns, one matrix product per batch."""
    import numpy as np

    left, right = zip(*combinations(range(len(columns)), 2))
    left, right = list(left), list(right)
    shift = np.array(centers)

    def summarise(batches):
        total = None
        for batch in batches:
            values = batch[columns].to_numpy(dtype="float64") - shift
            seen = ~np.isnan(values)
            x, m = np.where(seen, values, 0.0), seen.astype("float64")
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            yield pd.DataFrame({"a": left, "b": right, **{
                name: total[i][left, right] for i, name in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})

    return summarise


def correlation_pairs(shape: TableShape, columns: list[str], fewest: int = 2) -> DataFrame:
    """Pearson correlation of every column pair over rows that have both values.

    Each task reduces its rows to one row per pair; only those rows are shuffled. Values
    are centred first, so large means cost no precision. Constant pairs give null.
    """
    if len(columns) < 2:
        return shape.data.sparkSession.createDataFrame(
            [], "place int, variable_a string, variable_b string, n bigint, correlation double")
    numbers = shape.data.select(*[C(c).cast("double").alias(c) for c in columns])
    means = numbers.agg(*[F.avg(c).alias(c) for c in columns]).first()
    partial = numbers.mapInPandas(
        _pair_moments(columns, [means[c] or 0.0 for c in columns]),
        "a int, b int, n double, sx double, sy double, sxx double, syy double, sxy double")
    sums = partial.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    covariance = C("sxy") - C("sx") * C("sy") / C("n")
    spread_a, spread_b = C("sxx") - C("sx") * C("sx") / C("n"), C("syy") - C("sy") * C("sy") / C("n")
    varied = (C("n") >= fewest) & (spread_a > 1e-12 * C("sxx")) & (spread_b > 1e-12 * C("syy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        (C("a") * len(columns) + C("b")).alias("place"), F.get(names, C("a")).alias("variable_a"),
        F.get(names, C("b")).alias("variable_b"), C("n").cast("bigint").alias("n"),
        F.when(varied, F.round(covariance / (F.sqrt(spread_a) * F.sqrt(spread_b)), 6)).alias("correlation"))


def correlations(shape: TableShape, most: int = 15) -> DataFrame:
    pairs = correlation_pairs(shape, shape.numeric).filter(C("correlation").isNotNull())
    return pairs.withColumn("absolute_correlation", F.abs("correlation")).orderBy(
        C("absolute_correlation").desc(), "place").limit(most).select(
        "variable_a", "variable_b", "absolute_correlation")


def correlation_matrix(shape: TableShape, most: int = 12) -> DataFrame:
    """Signed matrix in long form: both directions and the diagonal."""
    columns = [c for c in ranked_numeric(shape) if shape.rows - shape.missing[c] >= 3][:most]
    pairs = correlation_pairs(shape, columns, 3).select("variable_a", "variable_b", "correlation")
    mirrored = pairs.select(C("variable_b").alias("variable_a"), C("variable_a").alias("variable_b"), "correlation")
    diagonal = _listed(shape, columns).select(
        C("variable").alias("variable_a"), C("variable").alias("variable_b"), F.lit(1.0).alias("correlation"))
    return pairs.unionByName(mirrored).unionByName(diagonal).filter(C("correlation").isNotNull())


def strongest_pair(shape: TableShape) -> DataFrame:
    columns = ranked_numeric(shape)[:10]
    pairs = correlation_pairs(shape, columns, 4).filter(C("correlation").isNotNull())
    return pairs.orderBy(F.abs("correlation").desc(), "place").limit(1).select(
        "variable_a", "variable_b", F.abs("correlation").alias("absolute_correlation"))


def numeric_trends(shape: TableShape, most: int = 12) -> DataFrame:
    """First against latest date per column, by median.

    Only rows at a column's two end dates matter, so their dates are found first and the
    medians are taken over those rows alone.
    """
    date = shape.dates[0]
    columns = shape.numeric[:most]
    rows = to_long(shape.data.filter(C(date).isNotNull()), [date], columns).filter(C("value").isNotNull())
    ends = rows.groupBy(C("variable").alias("end_variable")).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    tagged = rows.join(F.broadcast(ends), C("variable") == C("end_variable"))
    between = tagged.filter((C(date) > C("first")) & (C(date) < C("last"))).groupBy(
        C("variable").alias("mid_variable")).agg(F.count(F.lit(1)).alias("middle"))
    sided = tagged.filter((C(date) == C("first")) | (C(date) == C("last"))).select(
        "variable", F.when(C(date) == C("first"), "first").otherwise("last").alias("side"), "value")
    medians = exact_median(sided, ["variable", "side"], "value", bounded_groups=True).groupBy(C("variable").alias("m_variable")).agg(
        F.max(F.when(C("side") == "first", C("median"))).alias("first_value"),
        F.max(F.when(C("side") == "last", C("median"))).alias("latest_value"))
    joined = ends.join(F.broadcast(between), C("end_variable") == C("mid_variable")).join(
        F.broadcast(medians), C("end_variable") == C("m_variable"))
    return joined.select(
        C("end_variable").alias("variable"), C("first").alias("from_date"), C("last").alias("to_date"),
        "first_value", "latest_value",
        F.round(ratios.percent_change(C("latest_value"), C("first_value")), 6).alias("change_percent"),
        ratios.direction(C("latest_value"), C("first_value")).alias("direction"))


def record_frequency(shape: TableShape) -> DataFrame:
    """Rows in the first and the latest month, given at least three months."""
    month = periods.month_label(C(shape.dates[0]))
    counts = shape.data.filter(C(shape.dates[0]).isNotNull()).groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("month").alias("from_month"), F.max("month").alias("to_month"),
                      F.min_by("n", "month").alias("first_value"), F.max_by("n", "month").alias("latest_value"),
                      F.count(F.lit(1)).alias("months"))
    return ends.filter(C("months") >= 3).select(
        "from_month", "to_month", "first_value", "latest_value",
        F.round(ratios.percent_change(C("latest_value"), C("first_value")), 6).alias("change_percent"),
        ratios.direction(C("latest_value"), C("first_value")).alias("direction"))


def target_distribution(shape: TableShape, target: str) -> DataFrame:
    counts = shape.data.groupBy(F.coalesce(C(target).cast("string"), F.lit(MISSING)).alias("target_value")).agg(
        F.count(F.lit(1)).alias("records"))
    return counts.withColumn("share_percent", F.round(C("records") * 100.0 / shape.rows, 6))


def risk_segments(shape: TableShape, target: str, most: int = 3) -> DataFrame:
    """Category values of at least three rows with the highest share of risk labels."""
    columns = [c for c, n in shape.distinct.decided([c for c in shape.categorical if c != target], 20).items() if n <= 20]
    rows = shape.data.select(
        status.is_risk_label(C(target)).cast("int").alias("is_risk"),
        *[F.coalesce(C(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns])
    grouped = rows.unpivot(["is_risk"], columns, "variable", "group_value").groupBy("variable", "group_value").agg(
        F.count(F.lit(1)).alias("records"), F.sum("is_risk").alias("risk_records"))
    rate = C("risk_records") * 100.0 / C("records")
    place = F.row_number().over(Window.partitionBy("variable").orderBy(rate.desc(), C("group_value")))
    return grouped.filter(C("records") >= 3).withColumns(
        {"risk_percent": F.round(rate, 6), "place": place}).filter(C("place") <= most)


def exposure_columns(shape: TableShape, most: int = 3) -> list[str]:
    wanted = ("exposure", "transaction amount", "revenue / income")
    return [n for n in shape.numeric if any(w in " ".join(shape.roles[n]) for w in wanted)][:most]


def top_decile_share(shape: TableShape, columns: list[str] | None = None) -> DataFrame:
    """Share of the total held by the largest tenth of the values.

    The value at the cut is an exact order statistic, found together with the number and the
    sum of the values above it; the ties that fit are added. The table is read twice.
    """
    names = columns or exposure_columns(shape)

    def taken(n: int) -> int:
        return max(1, -(-n // 10))

    known = order_statistics(shape.data, {n: C(n) for n in names}, {"cut": lambda n: n - taken(n)}, lambda value: {"total": F.sum(value)})
    rows = []
    for name, column in known.items():
        if column.n and column.facts["total"] > 0:
            above, held = column.above["cut"]
            rows.append((name, (held + (taken(column.n) - above) * column.values["cut"]) / column.facts["total"]))
    table = shape.data.sparkSession.createDataFrame(rows, "variable string, share double")
    return table.select("variable", F.round("share", 6).alias("top_decile_share"))


# Measure -> header names accepted for it, in order.
METRIC_FIELDS = {
    "Revenue": ("revenue", "annual revenue", "annual sales", "net sales", "total sales", "sales", "turnover"),
    "Profit": ("net profit", "profit after tax", "profit after taxation", "pat", "net income"),
    "EBITDA": ("ebitda", "operating profit"),
    "Debt": ("total debt", "debt", "total borrowings", "borrowings", "loan balance", "loans"),
    "Assets": ("total assets", "assets"), "Liabilities": ("total liabilities", "liabilities"),
    "Current assets": ("current assets", "total current assets"),
    "Current liabilities": ("current liabilities", "total current liabilities"),
    "Inventory": ("inventory", "inventories", "stock"),
    "Interest expense": ("interest expense", "finance costs", "finance cost"),
    "Operating cash flow": ("operating cash flow", "cash flow from operations", "cash flow operations"),
    "Receivables": ("accounts receivable", "trade receivables", "receivables", "debtors"),
    "Equity": ("equity value", "shareholders equity", "shareholder equity", "owners equity", "net worth"),
    "Revenue growth": ("revenue growth", "sales growth"),
    "Profit margin": ("profit margin", "net profit margin"), "Current ratio": ("current ratio",),
    "Quick ratio": ("quick ratio",), "Debt-to-equity": ("debt to equity", "debt equity"),
    "Debt-to-assets": ("debt to assets", "debt assets ratio"), "Interest coverage": ("interest coverage",),
    "Operating margin": ("operating margin", "ebitda margin"),
}
PERIOD_FIELDS = ("period", "date", "year", "financial year", "fiscal year")
COMPANY_FIELDS = ("company id", "company", "customer id", "borrower id")


def financial_metrics(shape: TableShape, order_key: str, unbounded_history: bool = False) -> DataFrame:
    """Thirteen medians: a reported field, else row ratios with a non-zero denominator."""
    keys = {header_alnum_key(n): n for n in shape.data.columns}
    numeric = set(shape.numeric)

    def find(names) -> str | None:
        return next((keys[n] for n in names if n in keys), None)

    def measure(label) -> Column | None:
        name = find(METRIC_FIELDS[label])
        return C(name) if name in numeric and shape.missing[name] < shape.rows else None

    def over(top: Column | None, bottom: Column | None) -> Column | None:
        return None if top is None or bottom is None else ratios.nonzero_ratio(top, bottom)

    m = {label: measure(label) for label in METRIC_FIELDS}
    equity = m["Equity"]
    if equity is None and m["Assets"] is not None:
        other = m["Liabilities"] if m["Liabilities"] is not None else m["Debt"]
        equity = None if other is None else m["Assets"] - other
    quick = None if m["Current assets"] is None or m["Inventory"] is None else m["Current assets"] - m["Inventory"]

    def either(label, derived):
        return m[label] if m[label] is not None else derived

    chosen = {
        "Revenue": m["Revenue"], "Revenue growth": m["Revenue growth"], "Net profit": m["Profit"],
        "Profit margin": either("Profit margin", over(m["Profit"], m["Revenue"])),
        "Current ratio": either("Current ratio", over(m["Current assets"], m["Current liabilities"])),
        "Quick ratio": either("Quick ratio", over(quick, m["Current liabilities"])),
        "Debt-to-equity": either("Debt-to-equity", over(m["Debt"], equity)),
        "Debt-to-assets": either("Debt-to-assets", over(m["Debt"], m["Assets"])),
        "Interest coverage": either("Interest coverage", over(m["EBITDA"], m["Interest expense"])),
        "Operating margin": either("Operating margin", over(m["EBITDA"], m["Revenue"])),
        "Cash flow": m["Operating cash flow"], "Receivables": m["Receivables"], "Inventory": m["Inventory"],
    }
    middle = {"median": 0.5}
    medians = {label: k.values["median"] for label, k in order_statistics(
        shape.data, {label: value for label, value in chosen.items() if value is not None}, middle).items()}
    period = find(PERIOD_FIELDS)
    if chosen["Revenue growth"] is None and m["Revenue"] is not None and period in shape.dates:
        company = find(COMPANY_FIELDS)
        dated = shape.data.select(
            (F.coalesce(C(company).cast("string"), F.lit(MISSING)) if company else F.lit("all")).alias("company"),
            C(period).alias("period"), m["Revenue"].alias("revenue"), C(order_key).alias("row_key"),
        ).filter(C("period").isNotNull() & C("revenue").isNotNull())
        if unbounded_history or company is None:
            history = ordered.prior_values(dated, "company", ["period", "row_key"], ["revenue"])
        else:
            window = Window.partitionBy("company").orderBy("period", "row_key")
            history = dated.withColumn("prior_revenue", F.lag("revenue").over(window))
        growth = cut_lineage(history.filter(C("prior_revenue") != 0).select((C("revenue") / C("prior_revenue") - 1).alias("growth")))
        medians["Revenue growth"] = order_statistics(growth, {"growth": C("growth")}, middle)["growth"].values["median"]
    listed = shape.data.sparkSession.createDataFrame(
        [(place, label, medians.get(label)) for place, label in enumerate(chosen)], "place int, metric string, median double")
    return listed.select("place", "metric", F.round("median", 6).alias("value"))


def missing_ranking(shape: TableShape, most: int = 5) -> DataFrame:
    rows = [(n, shape.missing[n], shape.missing[n] * 100.0 / shape.rows) for n in shape.data.columns if shape.missing[n]]
    table = shape.data.sparkSession.createDataFrame(rows, "variable string, missing bigint, percent double")
    return table.select("variable", "missing", F.round("percent", 6).alias("missing_percent")).orderBy(
        C("missing").desc(), "variable").limit(most)


def column_answers(shape: TableShape) -> DataFrame:
    """What can be said about each column: a numeric summary or its commonest values."""
    spark = shape.data.sparkSession
    shape.distinct.settle(shape.data.columns)
    facts = spark.createDataFrame(
        [(n, shape.kinds[n], shape.rows - shape.missing[n], shape.missing[n], shape.distinct[n]) for n in shape.data.columns],
        "variable string, kind string, filled bigint, missing bigint, distinct_values bigint")
    numbers = numeric_summary(shape).select(C("variable").alias("n_variable"), "mean", C("p50").alias("median"), "min", "max")
    others = [n for n in shape.data.columns if n not in shape.numeric]
    top = top_values(shape, others, 5).groupBy(C("variable").alias("t_variable")).agg(
        F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "value", C("records").cast("string"))
                                             .alias("text")))).alias("tops"))  # five per column
    joined = facts.join(F.broadcast(numbers), C("variable") == C("n_variable"), "left").join(
        F.broadcast(top), C("variable") == C("t_variable"), "left")
    return joined.select("variable", "kind", "filled", "missing", "distinct_values", "mean", "median", "min", "max",
                         F.array_join(F.transform("tops", lambda t: t["text"]), ", ").alias("most_common"))


def histogram(shape: TableShape, columns: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """Equal-width counts; the largest value falls in the last bin."""
    names = columns or ranked_numeric(shape)[:4]
    n = bins or min(32, max(8, int(shape.rows ** 0.5)))
    rows = to_long(shape.data, [], names).filter(C("value").isNotNull())
    ends = rows.groupBy(C("variable").alias("end_variable")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    placed = F.floor(F.try_divide(C("value") - C("low"), C("high") - C("low")) * n).cast("int")
    bin_no = F.coalesce(F.least(placed, F.lit(n - 1)), F.lit(0))
    return rows.join(F.broadcast(ends), C("variable") == C("end_variable")).groupBy("variable", bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("records"))


def median_by_category(shape: TableShape, categories: list[str], metric: str, most: int = 12) -> DataFrame:
    used = [c for c, n in shape.distinct.decided(categories, most).items() if n <= most]
    rows = shape.data.filter(C(metric).isNotNull()).select(
        C(metric).alias("metric_value"), *[F.coalesce(C(c).cast("string"), F.lit(MISSING)).alias(c) for c in used])
    long = rows.unpivot(["metric_value"], used, "variable", "group_value")
    return exact_median(long, ["variable", "group_value"], "metric_value", bounded_groups=True).select(
        "variable", "group_value", F.round("median", 6).alias("median"))


def category_counts(shape: TableShape, columns: list[str], most: int = 12) -> DataFrame:
    return top_values(shape, columns, most).select("variable", "value", "records")


def median_series(shape: TableShape, columns: list[str]) -> DataFrame:
    """Median per day for each column; days are bounded in number."""
    day = C(shape.dates[0]).cast("date")
    rows = shape.data.select(day.alias("day"), *columns).filter(C("day").isNotNull())
    return exact_median(to_long(rows, ["day"], columns), ["variable", "day"], "value", bounded_groups=True).select(
        "variable", "day", F.round("median", 6).alias("median"))


def balance_totals(shape: TableShape, assets: str, liabilities: str) -> DataFrame:
    totals = shape.data.agg(F.sum(assets).alias("a"), F.sum(liabilities).alias("l"))
    return totals.select(F.explode(F.array(
        F.struct(F.lit("Assets").alias("measure"), F.round("a", 2).alias("total")),
        F.struct(F.lit("Liabilities").alias("measure"), F.round("l", 2).alias("total")))).alias("r")).select("r.*")


def numeric_means(shape: TableShape, most: int = 8) -> DataFrame:
    """Means of the first varying numeric columns."""
    names = [n for n, count in shape.distinct.decided(shape.numeric, 1).items() if count > 1][:most]
    return to_long(shape.data, [], names).groupBy("variable").agg(F.round(F.avg("value"), 4).alias("mean"))


def profile_warnings(shape: TableShape, trends: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Warning rows with severity, evidence, reason and action: gaps, declines, losses, thin liquidity, leverage, anomalies."""
    facts = advice.shape_facts(shape).unionByName(advice.value_facts(shape)).unionByName(advice.trend_facts(trends))
    if scored is not None:
        facts = facts.unionByName(advice.anomaly_facts(scored))
    return advice.warning_rows(facts)


def profile_findings(shape: TableShape, quality: DataFrame, pairs: DataFrame, trends: DataFrame) -> DataFrame:
    """Sentences about the table, built from the small result tables."""
    counts = (f"{len(shape.numeric)} numeric, {len(shape.categorical)} categorical and "
              f"{len(shape.dates)} date columns.")
    first = quality.select(F.explode(F.array(
        F.format_string("%d rows and %d columns; %.1f%% of cells are missing.", "n_rows", "n_columns", "missing_percent"),
        F.lit(counts), F.format_string("%d duplicate rows.", "duplicate_rows"))).alias("finding"))
    strongest = pairs.orderBy(C("absolute_correlation").desc()).limit(1).select(F.format_string(
        "Strongest association: %s with %s (%.2f).", "variable_a", "variable_b", "absolute_correlation").alias("finding"))
    moves = trends.select(F.concat(F.lit("Trend of "), "variable", F.lit(": "), F.lower("direction")).alias("finding"))
    found = first.unionByName(strongest).unionByName(moves)
    if shape.targets:
        text = f"Possible target {shape.targets[0]} with {shape.distinct[shape.targets[0]]} values."
        found = found.unionByName(shape.data.sparkSession.createDataFrame([(text,)], "finding string"))
    return found


def recommendations(shape: TableShape, trends: DataFrame | None = None, pairs: DataFrame | None = None, scored: DataFrame | None = None,
                    evaluated: bool = False) -> DataFrame:
    """(place, recommendation) by the rules of ``advice`` over what is known of the table."""
    facts = advice.shape_facts(shape)
    if trends is not None:
        facts = facts.unionByName(advice.trend_facts(trends))
    if pairs is not None:
        facts = facts.unionByName(advice.pair_facts(pairs))
    if scored is not None:
        facts = facts.unionByName(advice.anomaly_facts(scored))
    for target in shape.targets[:1]:
        facts = facts.unionByName(advice.target_facts(target, target_distribution(shape, target)))
        if any(c != target for c in shape.categorical):
            facts = facts.unionByName(advice.segment_facts(risk_segments(shape, target)))
        facts = facts.unionByName(advice.fact_rows(shape, [("model", 0, target, "evaluated" if evaluated else "not trained", None, None)]))
    return advice.recommendation_rows(facts)


def profile(shape: TableShape, key: str, scored: DataFrame | None = None, evaluated: bool = False) -> dict[str, DataFrame]:
    """The whole profile as named tables. ``scored`` has the rows' anomaly flags, and ``evaluated`` says that a model was held out,
    if they were made."""
    quality, pairs = dataset_quality(shape), correlations(shape)
    tables = {"quality": quality, "columns": column_profile(shape, key), "statistics": numeric_summary(shape),
              "categorical": categorical_summary(shape), "correlations": pairs}
    trends = numeric_trends(shape) if shape.dates and shape.numeric else None
    tables["recommendations"] = recommendations(shape, trends, pairs, scored, evaluated)
    if trends is not None:
        tables.update(trends=trends, warnings=profile_warnings(shape, trends, scored),
                      findings=profile_findings(shape, quality, pairs, trends))
    if shape.targets:
        target = shape.targets[0]
        tables.update(target_distribution=target_distribution(shape, target), risk_segments=risk_segments(shape, target))
    if exposure_columns(shape):
        tables["top_decile_share"] = top_decile_share(shape)
    return tables
