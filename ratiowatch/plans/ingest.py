"""Named ingestion queries: messy text, headers, grids, text statements, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.functions import numbers, periods, text
from ratiowatch.operators import documents, headers, merging
from ratiowatch.session import ensure_checkpoint_dir
from ratiowatch.sources import delimited, driver

import uuid

C = F.col


def q_text_keys(spark, sf_dir):
    label = F.concat(F.lit(" Sales & Tax (Rs.) [net]_"), C("o_orderpriority"), F.lit(" "), C("o_orderstatus"))
    return driver.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.spaced_key(label).alias("spaced"), text.alnum_key(label).alias("alnum"),
        text.label_key(label).alias("label"))


def q_parse_amount(spark, sf_dir):
    return driver.messy_amounts(spark, sf_dir).select(
        "o_orderkey", "amount_text", numbers.parse_amount(C("amount_text")).alias("amount"))


def q_parse_scaled_amount(spark, sf_dir):
    return driver.messy_amounts(spark, sf_dir).select(
        "o_orderkey", numbers.parse_scaled_amount(C("amount_text"), F.lit(1000.0)).alias("amount"))


def q_unit_scale(spark, sf_dir):
    return driver.messy_amounts(spark, sf_dir).select(
        "o_orderkey", numbers.unit_scale(C("amount_text")).alias("scale"))


def q_parse_period(spark, sf_dir):
    return driver.messy_periods(spark, sf_dir).select(
        "o_orderkey", "period_text", periods.parse_period(C("period_text")).alias("period"))


def q_normalize_headers(spark, sf_dir):
    data = driver.statements(spark, sf_dir)
    messy = data.select(C("company_id"), C("period").alias("Financial_Year"), C("Revenue").alias("Annual Revenue"),
                        C("Net_Profit").alias("PAT"), C("Total_Assets").alias("total-assets"),
                        C("Cash_Flow_Operations").alias("CFO"), C("Debt").alias(" Total  Borrowings "))
    return headers.normalize_headers(messy)


def q_normalize_tabular(spark, sf_dir):
    return headers.normalize_table(driver.borrower_export(spark, sf_dir))


def q_ingest_tabular(spark, sf_dir):
    return documents.ingest_table(driver.borrower_export(spark, sf_dir), "seq")


def q_collapse_periods(spark, sf_dir):
    return documents.ingest_table(driver.company_export(spark, sf_dir), "seq")


def q_header_row(spark, sf_dir):
    wide = documents.header_row(driver.wide_grid(spark, sf_dir)).withColumn("layout", F.lit("wide"))
    return wide.unionByName(documents.header_row(driver.long_grid(spark, sf_dir)).withColumn("layout", F.lit("long")))


def q_layout_kind(spark, sf_dir):
    grid = driver.transposed_grid(spark, sf_dir)
    names = ["Particulars", *[f"FY {y + 20}-{(y + 21) % 100:02d}" for y in driver.GRID_YEARS]]
    frame = grid.filter(C("row_no") > 0).select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)])
    loans = driver.loan_table(spark, sf_dir)
    return frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(headers.is_statement_layout(frame)).alias("items_by_year"),
        F.lit(headers.is_statement_layout(loans)).alias("loan_table"), "n_rows")


def q_wide_records(spark, sf_dir):
    return documents.wide_records(driver.wide_grid(spark, sf_dir)).select(
        "table_id", "company_id", "period", "Revenue", "Net_Profit", "Total_Assets")


def q_transposed_statement(spark, sf_dir):
    rows = documents.item_rows(driver.transposed_grid(spark, sf_dir))
    return merging.metric_rows_to_records(rows, "row_no").filter(C("Revenue").isNotNull()).select(
        "company_id", "period", "Revenue", "Net_Profit", "Accounts_Receivable", "Inventory", "Total_Assets")


def q_long_statement(spark, sf_dir):
    return documents.item_rows(driver.long_grid(spark, sf_dir)).select(
        "company_id", "period", "metric", "value")


def q_merge_records(spark, sf_dir):
    rows = documents.item_rows(driver.long_grid(spark, sf_dir))
    return merging.metric_rows_to_records(rows, "row_no").select(
        "company_id", "period", "Revenue", "Debt", "Current_Assets", "Current_Liabilities", "Accounts_Receivable", "Inventory")


def q_text_statement_records(spark, sf_dir):
    rows = documents.text_metric_rows(driver.text_statements(spark, sf_dir), "record_id", "text", F.lit("upload"))
    return rows.select("record_id", "company_id", "period", "metric", "value")


def q_document_company(spark, sf_dir):
    named = driver.text_statements(spark, sf_dir).select(
        F.concat(F.lit("s"), C("record_id").cast("string")).alias("document"), "text", F.lit("upload_file").alias("stem"))
    plain = driver.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), C("doc_id").cast("string")).alias("document"), "text", C("source").alias("stem"))
    return named.unionByName(plain).select("document", documents.document_company(C("text"), C("stem")).alias("company"))


def q_text_lines(spark, sf_dir):
    return documents.text_lines(driver.table(spark, sf_dir, "documents"), "doc_id", "text")


def _file(spark):
    return f"{ensure_checkpoint_dir(spark)}/file-{uuid.uuid4().hex}"


def q_read_delimited(spark, sf_dir):
    path = _file(spark)
    driver.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True, sep=";")
    return delimited.read_delimited(spark, path)


def q_read_quoted(spark, sf_dir):
    """Values that span lines and hold separators and quotes."""
    path = _file(spark)
    note = F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit(', "'), "c_nationkey", F.lit('"\n'))
    delimited.write_delimited(driver.table(spark, sf_dir, "customer").select("c_custkey", note.alias("note"), "c_acctbal"), path)
    return delimited.read_delimited(spark, path)


def q_read_grid(spark, sf_dir):
    """Every row with its number in its file, which the writer noted too; some values span lines."""
    path = _file(spark)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    driver.table(spark, sf_dir, "supplier").repartition(3).select(
        place.cast("string").alias("place"), "s_suppkey", F.concat("s_name", F.lit("\n|"), "s_nationkey").alias("name"), "s_nationkey").write.csv(
        path, sep="|", escape='"')
    return delimited.read_grid(spark, path).select(
        F.array_join(F.slice("cells", 2, 3), "/").alias("line"), (C("row_no") == F.get("cells", F.lit(0)).cast("bigint")).alias("in_order"))


STATEMENT_FILES = 16


def q_file_statements(spark, sf_dir):
    """Statement tables out of delimited files: a note, a header, and the companies of the file."""
    path = _file(spark)
    data = driver.wide_grid(spark, sf_dir)
    file = F.pmod(F.crc32(C("table_id")), F.lit(STATEMENT_FILES))
    first = data.groupBy(file.alias("file")).agg(F.min("table_id").alias("first_table"))
    rows = data.withColumn("file", file).join(first, "file").where((C("row_no") > 1) | (C("table_id") == C("first_table")))
    top = F.when(C("row_no") <= 1, C("row_no")).otherwise(2)
    quoted = F.transform("cells", lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')))
    lines = rows.repartition(STATEMENT_FILES, "file").sortWithinPartitions("file", top, "table_id", "row_no")
    lines.select("file", F.array_join(quoted, ",").alias("value")).write.partitionBy("file").text(path)
    grid = delimited.read_grid(spark, path)
    return documents.wide_records(grid).select("company_id", "period", "Revenue", "Net_Profit", "Total_Assets")


def q_sink_roundtrip(spark, sf_dir):
    path = _file(spark)
    delimited.write_delimited(driver.loans(spark, sf_dir).select("loan_id", "loan_amount", "loan_status", "country"), path)
    return delimited.read_delimited(spark, path).select(
        C("loan_id").cast("bigint").alias("loan_id"), C("loan_amount").cast("double").alias("loan_amount"),
        "loan_status", "country")


def q_stack_tables(spark, sf_dir):
    customers = driver.table(spark, sf_dir, "customer").select(
        C("c_name").alias("party"), C("c_acctbal").alias("balance"), C("c_mktsegment").alias("segment"))
    suppliers = driver.table(spark, sf_dir, "supplier").select(
        C("s_acctbal").alias("balance"), C("s_name").alias("party"), C("s_nationkey").alias("nation"))
    return delimited.stack(customers, suppliers)


QUERIES = {name[2:]: function for name, function in list(globals().items()) if name.startswith("q_")}
