"""Loan books: row risk, totals, concentration by borrower, vintages and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ratiowatch.functions import periods, ratios, status

C = F.col

# Column names looked for, in order of preference.
AMOUNT_COLUMNS = ("loan_amount", "exposure", "outstanding", "loan_balance", "credit_limit", "balance",
                  "amount", "sanctioned_amount")
COHORT_COLUMNS = ("origination_date", "disbursement_date", "disbursed_date", "loan_date", "sanction_date",
                  "start_date", "origination_year", "vintage_year", "vintage", "cohort")
BORROWER_COLUMNS = ("customer_id", "customer_name", "company_id", "loan_id")
STATUS_COLUMNS = ("default_status", "loan_status")
BAND_COLUMNS = ("portfolio_risk_category", "risk_category", "risk_status")
EXPOSURE_COLUMNS = ("loan_amount", "exposure", "outstanding", "loan_balance", "credit_limit", "balance", "amount")


def first_present(frame: DataFrame, candidates) -> str | None:
    """First candidate among the columns, ignoring case."""
    names = {name.strip().lower(): name for name in frame.columns}
    return next((names[c] for c in candidates if c in names), None)


def default_flag(frame: DataFrame) -> Column:
    column = first_present(frame, STATUS_COLUMNS)
    return status.observed_default(C(column)) if column else F.lit(None).cast("boolean")


def portfolio_risk(frame: DataFrame) -> DataFrame:
    """Band and basis per loan: reported status, then observed default, then score bands."""
    has = set(frame.columns)
    reported = status.reported_risk(C("risk_status")) if "risk_status" in has else F.lit(None).cast("string")
    raw = C("risk_status") if "risk_status" in has else F.lit(None).cast("string")
    score = ratios.finite(C("credit_score")) if "credit_score" in has else F.lit(None).cast("double")
    rows = frame.withColumns({
        "observed_default": default_flag(frame), "rb_score": score,
        "rb_first": F.coalesce(reported, F.lit("Not Assessed"))})
    known = C("rb_first") != "Not Assessed"
    rows = rows.withColumn("rb_second", F.when(C("observed_default"), "High Risk")
                           .when(~C("observed_default") & ~known, "Low Risk").otherwise(C("rb_first")))
    middling = (C("rb_score") < 670) & (C("rb_second") != "High Risk")
    unassessed = (C("rb_score") >= 670) & (C("rb_second") == "Not Assessed")
    final = (F.when(C("rb_score") < 580, "High Risk").when(middling, "Moderate Risk")
             .when(unassessed, "Low Risk").otherwise(C("rb_second")))
    reasons = F.array(
        F.when(known, F.concat(F.lit("Reported risk status: "), raw)),
        F.when(C("observed_default"), "Observed default or delinquency status")
        .when(~C("observed_default") & ~known, "Observed non-default/performing status"),
        F.when(C("rb_score") < 580, "Credit score below 580").when(middling, "Credit score below 670")
        .when(unassessed, "Credit score at or above 670"),
    )
    basis = F.array_join(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())), "; ")
    return rows.withColumns({
        "portfolio_risk_category": final,
        "risk_basis": F.when(basis == "", "No recognized risk value was available").otherwise(basis),
    }).drop("rb_score", "rb_first", "rb_second")


def portfolio_summary(rows: DataFrame) -> DataFrame:
    """One row of totals over ``portfolio_risk`` rows; figures without a column are null."""
    defaulted = C("observed_default")
    band = C("portfolio_risk_category")
    owner = first_present(rows, ("customer_id", "loan_id", "customer_name", "company_id"))
    score = ratios.finite(C("credit_score")) if "credit_score" in rows.columns else F.lit(None).cast("double")
    amount = ratios.finite(C("loan_amount")) if "loan_amount" in rows.columns else F.lit(None).cast("double")
    return rows.agg(
        F.count(F.lit(1)).alias("records"),
        (F.countDistinct(owner) if owner else F.lit(None).cast("bigint")).alias("unique_customers"),
        F.count_if(defaulted).alias("observed_defaults"), F.count(defaulted).alias("observed_coverage"),
        F.try_divide(F.count_if(defaulted), F.count(defaulted)).alias("observed_default_rate"),
        F.avg(score).alias("average_credit_score"),
        F.round(F.avg(amount), 4).alias("average_loan_amount"),
        F.round(F.sum(amount), 2).alias("total_loan_amount"),
        F.count_if(band == "High Risk").alias("high_records"),
        F.count_if(band == "Moderate Risk").alias("moderate_records"),
        F.count_if(band == "Low Risk").alias("low_records"),
        F.count_if(band != "Not Assessed").alias("assessed_records"),
    )


def positive_exposure(frame: DataFrame, amount: str | None = None) -> DataFrame:
    column = amount or first_present(frame, AMOUNT_COLUMNS)
    if column is None:
        raise ValueError("No exposure, balance or loan-amount column was found.")
    return frame.withColumn("exposure_value", ratios.finite(C(column))).filter(C("exposure_value") > 0)


def borrower_exposure(frame: DataFrame, amount: str | None = None, borrower: str | None = None) -> DataFrame:
    """Exposure and loans per borrower; summed on the map side before the shuffle."""
    valued = positive_exposure(frame, amount)
    column = borrower or first_present(frame, BORROWER_COLUMNS)
    if column is None:
        raise ValueError("No borrower column was found.")
    return valued.groupBy(C(column).alias("borrower")).agg(
        F.sum("exposure_value").alias("exposure"), F.count(F.lit(1)).alias("loans"))


def concentration(per_borrower: DataFrame) -> DataFrame:
    """HHI, its inverse and the top shares in one row.

    HHI is the sum of squares over the square of the sum, so the total needs no second
    pass; the ten largest come from a top-k, not from a sort of all borrowers.
    """
    totals = per_borrower.agg(
        F.count(F.lit(1)).alias("borrowers"), F.sum("exposure").alias("total"),
        F.sum(C("exposure") * C("exposure")).alias("squares"), F.max("exposure").alias("largest"))
    top = top_borrowers(per_borrower, 10)
    place = F.row_number().over(Window.orderBy(C("exposure").desc(), C("borrower")))
    sums = top.withColumn("place", place).agg(
        F.sum(F.when(C("place") <= 5, C("exposure"))).alias("top_5"), F.sum("exposure").alias("top_10"))
    merged = totals.unionByName(sums, allowMissingColumns=True).agg(
        *[F.max(name).alias(name) for name in ("borrowers", "total", "squares", "largest", "top_5", "top_10")])
    hhi = C("squares") / (C("total") * C("total"))
    return merged.select(
        "borrowers", F.round("total", 2).alias("total_exposure"), F.round(hhi, 6).alias("herfindahl_index"),
        F.round(1 / hhi, 3).alias("effective_borrowers"),
        F.round(C("largest") / C("total"), 6).alias("largest_exposure_share"),
        F.round(C("top_5") / C("total"), 6).alias("top_5_share"),
        F.round(C("top_10") / C("total"), 6).alias("top_10_share"))


def top_borrowers(per_borrower: DataFrame, rows: int = 10) -> DataFrame:
    return per_borrower.orderBy(C("exposure").desc(), C("borrower")).limit(rows)


def top_exposures(per_borrower: DataFrame, rows: int = 10) -> DataFrame:
    total = per_borrower.agg(F.sum("exposure")).scalar()
    return top_borrowers(per_borrower, rows).select(
        "borrower", "loans", F.round("exposure", 2).alias("exposure"),
        F.round(C("exposure") / total * 100, 4).alias("share_percent"))


def exposure_by_band(frame: DataFrame, amount: str | None = None) -> DataFrame:
    band = first_present(frame, BAND_COLUMNS)
    grouped = positive_exposure(frame, amount).groupBy(
        F.coalesce(C(band).cast("string"), F.lit("Not Assessed")).alias("risk_category")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("exposure_value").alias("exposure"))
    whole = Window.partitionBy(F.lit(0))  # one row per band
    return grouped.select(
        "risk_category", "records", F.round("exposure", 2).alias("exposure"),
        F.round(C("exposure") / C("records"), 4).alias("average_exposure"),
        F.round(C("exposure") / F.sum("exposure").over(whole) * 100, 4).alias("share_percent"))


def cohort_label(frame: DataFrame, column: str, freq: str = "year") -> Column:
    """Years, dates or vintage text; text columns are inspected with one aggregate."""
    if freq not in ("year", "quarter"):
        raise ValueError("freq must be 'year' or 'quarter'.")
    kind = frame.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return periods.cohort_of_date(C(column), freq)
    number = ratios.finite(C(column))
    date = C(column).cast("string").try_cast("date")
    seen = frame.agg(
        F.bool_and(F.coalesce(number.between(1900, 2100), F.lit(False))).alias("years"),
        F.coalesce(F.bool_or(date.isNotNull()), F.lit(False)).alias("dates")).first()
    if seen["years"]:
        return number.try_cast("bigint").cast("string")
    if seen["dates"]:
        return periods.cohort_of_date(date, freq)
    return F.trim(C(column).cast("string"))


def vintages(frame: DataFrame, column: str | None = None, freq: str = "year") -> DataFrame:
    """Observed default rate, exposure and mean score per origination cohort."""
    dated = column or first_present(frame, COHORT_COLUMNS)
    if dated is None:
        raise ValueError("No origination or vintage column was found.")
    amount = first_present(frame, AMOUNT_COLUMNS)
    exposure = ratios.finite(C(amount)) if amount else F.lit(None).cast("double")
    score = ratios.finite(C("credit_score")) if "credit_score" in frame.columns else F.lit(None).cast("double")
    rows = frame.select(cohort_label(frame, dated, freq).alias("cohort"),
                        default_flag(frame).cast("int").alias("defaulted"),
                        exposure.alias("exposure"), score.alias("score"))
    grouped = rows.filter(F.trim("cohort") != "").groupBy("cohort").agg(
        F.count(F.lit(1)).alias("records"), F.avg("defaulted").alias("default_rate"),
        F.count("defaulted").alias("observed_records"), F.sum("exposure").alias("exposure"),
        F.avg("score").alias("average_credit_score"))
    whole = Window.partitionBy(F.lit(0))  # one row per cohort
    return grouped.select(
        "cohort", "records", "default_rate", "observed_records", F.round("exposure", 2).alias("exposure"),
        F.round(F.try_divide(C("exposure"), F.sum("exposure").over(whole)) * 100, 4).alias("exposure_share_percent"),
        "average_credit_score")


def concentration_findings(metrics: DataFrame) -> DataFrame:
    def share(name):
        return F.format_string("%.1f%%", C(name) * 100)

    grade = (F.when(C("top_10_share") >= 0.50, "highly concentrated")
             .when(C("top_10_share") >= 0.25, "moderately concentrated").otherwise("well spread"))
    return metrics.select(F.explode(F.array(
        F.concat(F.lit("Ten largest borrowers hold "), share("top_10_share"), F.lit(" of exposure: "), grade),
        F.concat(F.lit("Largest borrower holds "), share("largest_exposure_share")),
        F.format_string("About %.1f equally sized borrowers", C("effective_borrowers")),
    )).alias("finding")).select(F.lit("concentration").alias("topic"), "finding")


def vintage_findings(cohorts: DataFrame) -> DataFrame:
    rated = cohorts.filter(C("default_rate").isNotNull())
    whole = Window.partitionBy(F.lit(0))  # one row per cohort
    marked = rated.select("cohort", "default_rate", F.max("default_rate").over(whole).alias("high"),
                          F.min("default_rate").over(whole).alias("low"))
    ends = marked.agg(
        F.min(F.when(C("default_rate") == C("high"), C("cohort"))).alias("worst"), F.max("high").alias("high"),
        F.min(F.when(C("default_rate") == C("low"), C("cohort"))).alias("best"), F.min("low").alias("low"))
    sentence = F.array(
        F.format_string("Highest observed default rate: cohort %s at %.1f%%", C("worst"), C("high") * 100),
        F.when(C("worst") != C("best"),
               F.format_string("Lowest observed default rate: cohort %s at %.1f%%", C("best"), C("low") * 100)))
    return ends.filter(C("worst").isNotNull()).select(
        F.lit("vintage").alias("topic"), F.explode(sentence).alias("finding")).filter(C("finding").isNotNull())


def analyze(frame: DataFrame) -> dict[str, DataFrame]:
    """The loan-book analysis as named tables, as far as the columns allow."""
    rows = portfolio_risk(frame)
    tables = {"customers": rows, "summary": portfolio_summary(rows)}
    if first_present(rows, AMOUNT_COLUMNS) is None or first_present(rows, COHORT_COLUMNS) is None:
        return tables
    per_borrower = borrower_exposure(rows)
    metrics = concentration(per_borrower)
    cohorts = vintages(rows)
    return {
        **tables, "concentration": metrics,
        "top_exposures": top_exposures(per_borrower), "exposure_by_band": exposure_by_band(rows),
        "vintage": cohorts,
        "findings": concentration_findings(metrics).unionByName(vintage_findings(cohorts)),
    }
