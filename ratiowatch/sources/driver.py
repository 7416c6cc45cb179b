"""Views over the driver's parquet tables in the shapes the operators expect.

Sums of money are taken over whole numbers of 1/10000 currency unit, so the result
does not depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and calendar year of order.

    Lines are summed per order before the join, and orders per customer-year before
    the customer join, so no join ever sees a repeated key on both sides.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linestatus", "l_returnflag",
        (_cents("l_extendedprice") * (100 - _cents("l_discount"))).alias("net"),
        (_cents("l_extendedprice") * (78 + 3 * _cents("l_tax"))).alias("cost"),
        (_cents("l_extendedprice") * (60 + 2 * _cents("l_tax"))).alias("goods"),
    )

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("net")).otherwise(F.lit(0).cast("bigint")))

    per_order = lines.groupBy("l_orderkey").agg(
        F.sum("net").alias("net"), F.sum("cost").alias("cost"), F.sum("goods").alias("goods"),
        part(F.col("l_linestatus") == "O").alias("net_open"),
        part(F.col("l_returnflag") == "R").alias("net_returned"),
        part(F.col("l_returnflag") == "N").alias("net_new"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("year"),
        "o_orderstatus")
    joined = orders.join(per_order, "l_orderkey")
    per_year = joined.groupBy("o_custkey", "year").agg(
        *[F.sum(name).alias(name) for name in ("net", "cost", "goods", "net_open", "net_returned", "net_new")],
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("net")).otherwise(F.lit(0).cast("bigint")))
        .alias("net_funded"),
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    base = per_year.join(customers, "o_custkey")

    def amount(name: str) -> Column:
        return F.col(name) / F.lit(10000.0)

    key = F.col("o_custkey")
    base = base.select(
        (key * 10000 + F.col("year")).alias("record_id"),
        key.cast("string").alias("company_id"),
        F.make_date(F.col("year"), F.lit(12), F.lit(31)).alias("period"),
        (key % 11 == 0).alias("hide_debt"), (key % 7 == 0).alias("hide_interest"),
        (key % 97 == 0).alias("hide_all"), "c_acctbal",
        amount("net").alias("Revenue"), (amount("net") - amount("cost")).alias("EBITDA"),
        (amount("net_funded") * 0.55).alias("full_debt"),
        (amount("net_open") * 0.35).alias("Accounts_Receivable"),
        (amount("net_returned") * 0.35).alias("Inventory"),
        (amount("net_new") * 0.75).alias("Current_Liabilities"),
        amount("goods").alias("Cost_of_Goods_Sold"),
    )
    c = F.col
    measures = {
        "EBITDA": c("EBITDA"),
        "Net_Profit": c("EBITDA") - c("Revenue") * 0.06 - c("full_debt") * 0.08,
        "Total_Assets": c("Revenue") * 0.45 + c("Accounts_Receivable") + c("Inventory"),
        "Total_Liabilities": c("Current_Liabilities") + c("full_debt") * 0.8,
        "Current_Assets": c("Accounts_Receivable") + c("Inventory") + F.greatest(c("c_acctbal"), F.lit(0.0)),
        "Current_Liabilities": c("Current_Liabilities"),
        "Cash_Flow_Operations": c("EBITDA") - c("Accounts_Receivable") * 0.25,
        "Debt": F.when(~c("hide_debt"), c("full_debt")),
        "Interest_Expense": F.when(~c("hide_interest"), c("full_debt") * 0.08),
        "Accounts_Receivable": c("Accounts_Receivable"),
        "Inventory": c("Inventory"),
        "Cost_of_Goods_Sold": c("Cost_of_Goods_Sold"),
    }
    return base.select(
        "record_id", "company_id", "period", "Revenue",
        *[F.when(~c("hide_all"), value).alias(name) for name, value in measures.items()],
        F.lit(None).cast("double").alias("Sales_Growth"),
    )


def loans(spark: SparkSession, sf_dir: str, borrower: bool = True, places: bool = True) -> DataFrame:
    """One row per order as a loan, with the borrower's score, segment and location.

    Questions about loans alone leave the ``borrower`` out, and those about scores the
    ``places``: an inner join that adds no wanted column would still be executed.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), "c_nationkey", F.col("c_mktsegment").alias("segment"),
        F.floor(300 + (F.col("c_acctbal") + 1000) / 11000 * 600).cast("bigint").alias("credit_score"))
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"), "n_regionkey")
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    book = orders.select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("loan_amount"), F.col("o_orderdate").alias("origination_date"),
        F.when(status == "F", "Default").when(status == "O", "Current").when(status == "P", "Fully Paid")
        .alias("loan_status"),
        F.when(priority == "1-URGENT", "Critical").when(priority == "2-HIGH", "High")
        .when(priority == "3-MEDIUM", "Medium").when(priority == "5-LOW", "Low").alias("risk_status"),
    )
    if not borrower:
        return book
    book = book.join(customers, "customer_id")
    if places:
        book = book.join(nations, "c_nationkey").join(regions, "n_regionkey")
    return book.drop("c_nationkey", "n_regionkey")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probability from the borrower's score and the observed default of each loan."""
    score = F.col("credit_score")
    return loans(spark, sf_dir, places=False).select(
        "loan_id", "customer_id", "segment",
        ((900 - score) / F.lit(600.0)).alias("probability"),
        F.when(F.col("loan_status") == "Default", 1).otherwise(0).alias("label"),
    )


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as an unfamiliar table for profiling."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def loan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan book as an unfamiliar table for profiling."""
    return loans(spark, sf_dir).select(
        "loan_id", "customer_id", "loan_amount", "credit_score", "origination_date",
        "loan_status", "risk_status", "segment", "country", "region")


def statement_profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-period statements without the technical key."""
    return statements(spark, sf_dir).drop("Sales_Growth")


def messy_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written the way people write amounts."""
    orders = table(spark, sf_dir, "orders")
    cents = _cents("o_totalprice")
    units = F.floor(cents / 100).cast("bigint")
    plain = F.concat(units.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    grouped = F.concat(F.format_number(units, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    kind = F.col("o_orderkey") % 8
    text = (
        F.when(kind == 0, plain).when(kind == 1, grouped).when(kind == 2, F.concat(F.lit("₹"), grouped))
        .when(kind == 3, F.concat(F.lit("Rs. "), plain, F.lit(" Lakhs")))
        .when(kind == 4, F.concat(plain, F.lit(" Crore")))
        .when(kind == 5, F.concat(F.lit("("), grouped, F.lit(")")))
        .when(kind == 6, F.lit("n/a")).otherwise(F.lit(""))
    )
    return orders.select("o_orderkey", "o_custkey", text.alias("amount_text"))


def messy_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates moved 20 years on and written in five styles."""
    orders = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate") + 20
    nxt = (year + 1) % 100
    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, year.cast("string"))
        .when(kind == 1, F.concat(F.lit("FY "), year.cast("string"), F.lit("-"), F.lpad(nxt.cast("string"), 2, "0")))
        .when(kind == 2, F.concat(year.cast("string"), F.date_format("o_orderdate", "-MM-dd")))
        .when(kind == 3, F.concat(year.cast("string"), F.lit("/"), (year + 2).cast("string")))
        .when(kind == 4, F.concat(year.cast("string"), F.date_format("o_orderdate", "-MM")))
        .otherwise(F.lit("not stated"))
    )
    return orders.select("o_orderkey", text.alias("period_text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First replies of conversations as reviewer notes."""
    decision = F.col("conv_id") % 6
    names = ("Pending review", "Approve with monitoring", "Approve with conditions",
             "Refer to committee", "Decline", "Maybe")
    chain = F.lit(names[-1])
    for number, name in enumerate(names[:-1]):
        chain = F.when(decision == number, F.lit(name)).otherwise(chain)
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id"), F.col("turn"), F.col("role").alias("author"),
        F.col("text").alias("note"), chain.alias("decision"))


def messy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an unfamiliar export: text amounts, text days, a year number and a status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    amounts = messy_amounts(spark, sf_dir).select("o_orderkey", F.when(F.col("amount_text") != "", F.col("amount_text"))
                                                  .alias("sanctioned_amount"))
    kind = F.col("o_orderkey") % 10
    return orders.join(amounts, "o_orderkey").select(
        F.col("o_orderkey").alias("order_number"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("booked_on"),
        F.year("o_orderdate").alias("financial_year"), "sanctioned_amount",
        F.when(kind < 3, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("channel"),
        F.col("o_orderstatus").alias("risk_flag"),
        F.when(kind == 0, "true").otherwise(F.concat(F.lit("text "), kind.cast("string"))).alias("remark"))


def _whole(value: Column) -> Column:
    """A whole amount as people print it: thousands separators, brackets when negative."""
    units = F.floor(value).cast("bigint")
    shown = F.when(units < 0, F.concat(F.lit("("), F.format_number(-units, 0), F.lit(")"))).otherwise(
        F.format_number(units, 0))
    return F.coalesce(shown, F.lit("-"))


def _fiscal(year: Column) -> Column:
    later = year + 20
    return F.concat(F.lit("FY "), later.cast("string"), F.lit("-"), F.lpad(((later + 1) % 100).cast("string"), 2, "0"))


def wide_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per company: a unit note, a header row, then one row per year."""
    data = statements(spark, sf_dir)
    year = F.year("period")
    body = data.select(
        F.col("company_id").alias("table_id"), (year - 1988).alias("row_no"),
        F.array(F.concat(F.lit("Customer "), "company_id"), _fiscal(year), _whole(F.col("Revenue")),
                _whole(F.col("Net_Profit")), _whole(F.col("Total_Assets"))).alias("cells"))
    note = F.array(F.lit("All figures in Rs. Thousands"), *[F.lit(None).cast("string")] * 4)
    head = F.array(*[F.lit(t) for t in ("Company Name", "Financial Year", "Turnover", "Net Profit (Rs. Lakh)", "Total Assets")])
    heads = data.select(F.col("company_id").alias("table_id")).distinct().select(
        "table_id", F.posexplode(F.array(note, head)).alias("row_no", "cells"))
    return body.unionByName(heads)


GRID_YEARS = range(1995, 2002)
GRID_ITEMS = {"Revenue": "Revenue", "Profit After Tax": "Net_Profit", "Trade Receivables": "Accounts_Receivable",
              "Inventories": "Inventory", "Total Assets": "Total_Assets"}


def transposed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per company: items down the rows, fiscal years across."""
    data = statements(spark, sf_dir)
    years = data.groupBy("company_id").agg(*[
        F.max(F.when(F.year("period") == y, F.col(m))).alias(f"{m}_{y}") for m in GRID_ITEMS.values() for y in GRID_YEARS])
    head = F.array(F.lit("Particulars (Rs. in Thousands)"), *[
        F.lit(f"FY {y + 20}-{(y + 21) % 100:02d}") for y in GRID_YEARS])
    rows = [head] + [F.array(F.lit(item), *[_whole(F.col(f"{m}_{y}")) for y in GRID_YEARS])
                     for item, m in GRID_ITEMS.items()]
    return years.select(F.col("company_id").alias("table_id"), F.posexplode(F.array(*rows)).alias("row_no", "cells"))


def long_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid per company: item, reporting period and amount on every row; no totals."""
    data = statements(spark, sf_dir)
    year = F.year("period")
    items = {"Net Sales": F.col("Revenue"), "Short term borrowings": F.col("Debt") * 0.25,
             "Long-term borrowings": F.col("Debt") * 0.75, "Trade payables": F.col("Current_Liabilities") * 0.5,
             "Cash & bank balances": F.col("Revenue") * 0.125, "Debtors": F.col("Accounts_Receivable"),
             "Stock": F.col("Inventory")}
    rows = F.array(*[F.struct((place + (year - 1994) * 10).alias("row_no"),
                              F.array(F.lit(item), _fiscal(year), _whole(value)).alias("cells"))
                     for place, (item, value) in enumerate(items.items())])
    body = data.select(F.col("company_id").alias("table_id"), F.explode(rows).alias("r")).select("table_id", "r.*")
    head = data.select(F.col("company_id").alias("table_id")).distinct().select(
        "table_id", F.lit(0).alias("row_no"), F.array(*[F.lit(t) for t in ("Line Item", "Reporting Period", "Amount")]).alias("cells"))
    return body.unionByName(head)


def text_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short text per company and year, as a document parser would leave it."""
    data = statements(spark, sf_dir)
    body = F.concat_ws(
        "\n", F.concat(F.lit("Company Name: Customer "), "company_id"),
        F.concat(F.lit("Financial Year: "), F.substring(_fiscal(F.year("period")), 4, 7)),
        F.lit("Amounts in Rs. Thousands"), F.lit(""),
        F.concat(F.lit("Revenue: Rs. "), _whole(F.col("Revenue"))),
        F.concat(F.lit("PAT | "), _whole(F.col("Net_Profit"))),
        F.concat(F.lit("Total Assets   "), _whole(F.col("Total_Assets")), F.lit(" Lakhs")),
        F.lit("Prepared by the accounts team"))
    return data.select("record_id", "company_id", "period", body.alias("text"))


def borrower_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a borrower file with two income columns and units in the headers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    amounts = messy_amounts(spark, sf_dir).select("o_orderkey", "amount_text")
    year = F.year("o_orderdate")
    return orders.join(amounts, "o_orderkey").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("Borrower ID"),
        _fiscal(year).alias("Financial Year"),
        F.col("amount_text").alias("Turnover (Rs. Lakh)"), F.col("o_totalprice").cast("string").alias("Annual Income"),
        F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(" lakh")).alias("Loan Amount"),
        F.col("o_orderstatus").alias("Repayment-Status"))


def company_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a statement export with several partial rows per company and year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    kind, price = F.col("o_orderkey") % 3, _whole(F.col("o_totalprice"))
    return orders.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("Company Name"),
        _fiscal(F.year("o_orderdate")).alias("Financial Year"),
        F.when(kind == 0, price).alias("Turnover (Rs. Thousand)"), F.when(kind == 1, price).alias("Borrowings"),
        F.when(kind == 2, price).alias("Current Assets"))
