"""Messy headers, numbers, periods, grids and texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ratiowatch.functions import numbers, periods, text
from ratiowatch.operators import documents, headers, merging, profile, typing_rules
from ratiowatch.sources import delimited


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(
        column(F.col("t"))).collect()]


def test_amounts(spark):
    cases = {"₹1,00,000": 1e5, "Rs. 2 Lakhs": 2e5, "3 crores": 3e7, "(1,234.5)": -1234.5, "12%": 12.0, "1.5e3": 1500.0, "n/a": None,
             "--": None, "": None, "abc": None, "USD 10k": 1e4, "-7": -7.0, "1 2": None, "€5 mn": 5e6}
    assert values(spark, numbers.parse_amount, list(cases)) == list(cases.values())


def test_scaled_amounts(spark):
    cases = {"1.25": 1250.0, "2 lakh": 2e5, "(3)": -3000.0, "Rs. 1,000": 1e6, "nil": None, "–": None, "12-5": None, "5.": 5000.0}
    assert values(spark, lambda c: numbers.parse_scaled_amount(c, F.lit(1000.0)), list(cases)) == list(cases.values())


def test_periods(spark):
    cases = {"2017": dt.date(2017, 12, 31), "FY 2023-24": dt.date(2024, 3, 31), "2024-03-31": dt.date(2024, 3, 31),
             "2017/2019": dt.date(2019, 12, 31), "2024-03": dt.date(2024, 3, 31), "31/12/1999": None, "12/31/1999": dt.date(1999, 12, 31),
             "5 Mar 1998": dt.date(1998, 3, 5), "12345": None, "n/a": None, "2099-00": dt.date(2100, 3, 31)}
    assert values(spark, periods.parse_period, list(cases)) == list(cases.values())


def test_keys(spark):
    raw = [" Sales &  Tax_(Rs.) [x] "]
    assert values(spark, text.spaced_key, raw) == ["sales & tax (rs.) [x]"]
    assert values(spark, text.label_key, raw) == ["sales and tax"] == [text.header_label_key(raw[0])]


def test_header_normalisation(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "`Annual Revenue` int, `total-assets` int, city int")
    assert headers.normalize_headers(frame).columns == ["Revenue", "Total_Assets", "city"]
    with pytest.raises(ValueError):
        headers.normalize_headers(spark.createDataFrame([(1, 2)], "Sales int, Turnover int"))


def test_units_in_headers(spark):
    frame = spark.createDataFrame(
        [(1, "Acme Industries", "FY 2023-24", "1.25", "50", "0.4", "1000000", "500000")],
        "seq int, `Company Name` string, `Financial Year` string, `Turnover (Rs. Crore)` string, `PAT (Rs. Lakh)` string, "
        "`Borrowings (Crore)` string, `Current Assets` string, `Current Liabilities` string")
    row = documents.ingest_table(frame, "seq").first()
    assert (row.company_id, row.period) == ("Acme Industries", dt.date(2024, 3, 31))
    assert (row.Revenue, row.Net_Profit, row.Debt, row.Current_Assets) == (12_500_000, 5_000_000, 4_000_000, 1_000_000)


def test_borrower_file(spark):
    frame = spark.createDataFrame(
        [(1, "B-01", "1000000", "100000", "250000", "710", "No"), (2, "B-02", "800000", "-20000", "350000", "560", "Yes")],
        "seq int, `Borrower ID` string, `Annual Income` string, Profit string, Debt string, `Credit Score` string, Default string")
    rows = documents.ingest_table(frame, "seq").orderBy("seq").collect()
    assert headers.table_kind(documents.ingest_table(frame, "seq").columns) == "customer_loan_dataset"
    assert [(r.company_id, r.Revenue, r.Net_Profit, r.Debt, r.credit_score, r.default_status) for r in rows] == [
        ("B-01", 1e6, 1e5, 250000, 710, "No"), ("B-02", 8e5, -2e4, 350000, 560, "Yes")]


def grid(spark, rows, table="t"):
    return spark.createDataFrame([(table, i, list(r)) for i, r in enumerate(rows)], "table_id string, row_no int, cells array<string>")


def merged(rows):
    return merging.metric_rows_to_records(rows, "row_no").orderBy("period").collect()


def test_transposed_statement(spark):
    rows = merged(documents.item_rows(grid(spark, [
        ["Particulars", "FY 2022-23", "FY 2023-24"], ["Revenue", "10,00,000", "12,00,000"], ["Net Profit", "1,00,000", "1,50,000"]])))
    assert [(r.period, r.Revenue, r.Net_Profit) for r in rows] == [
        (dt.date(2023, 3, 31), 1e6, 1e5), (dt.date(2024, 3, 31), 1.2e6, 1.5e5)]


def test_vertical_statement_in_crores_derives_totals(spark):
    latest = merged(documents.item_rows(grid(spark, [
        ["Particulars (Rs. in Crores)", "FY 2022-23", "FY 2023-24"], ["Cash and Cash Equivalents", "0.5", "0.6"],
        ["Trade Receivables", "0.2", "0.3"], ["Inventory", "0.3", "0.4"], ["Trade Payables", "0.5", "0.5"],
        ["Short Term Borrowings", "0.1", "0.1"]])))[-1]
    assert (latest.Current_Assets, latest.Current_Liabilities, latest.Debt) == pytest.approx((13e6, 6e6, 1e6))


def test_two_tables_merge_into_one_record(spark):
    both = grid(spark, [["Company", "Year", "Sales", "Current Assets"], ["Acme", "2024", "₹ 10,00,000", "500000"]], "income").unionByName(
        grid(spark, [["Company", "Year", "Borrowings", "Total Assets"], ["Acme", "2024", "100000", "800000"]], "balance"))
    records = documents.wide_records(both)
    rows = merging.merge_records(records, "row_no").collect()
    assert len(rows) == 1
    assert (rows[0].Revenue, rows[0].Debt, rows[0].Total_Assets) == (1e6, 1e5, 8e5)


def test_year_numbers_as_headers(spark):
    rows = merged(documents.item_rows(grid(spark, [["Particulars", "2023", "2024"], ["Revenue", "1000000", "1200000"]])))
    assert [r.period for r in rows] == [dt.date(2023, 12, 31), dt.date(2024, 12, 31)]


def test_text_statement(spark):
    body = "Company Name: Acme Manufacturing\nFinancial Year: 2023-24\nRevenue: Rs. 10,00,000\nPAT: Rs. 1,25,000\nNote: none"
    rows = documents.text_metric_rows(spark.createDataFrame([(1, body)], "doc int, text string"), "doc", "text", F.lit("x")).collect()
    assert {(r.company_id, r.period, r.metric, r.value) for r in rows} == {
        ("Acme Manufacturing", dt.date(2024, 3, 31), "Revenue", 1e6), ("Acme Manufacturing", dt.date(2024, 3, 31), "Net_Profit", 125000.0)}


def test_whole_text_is_read(spark):
    body = "\n".join(["filler line"] * 5000 + ["Revenue: 5,000"])
    rows = documents.text_metric_rows(spark.createDataFrame([(1, body)], "doc int, text string"), "doc", "text", F.lit("file_a")).collect()
    assert [(r.line_no, r.value, r.company_id) for r in rows] == [(5000, 5000.0, "file a")]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;amount\nCaf\xe9;1\nBar;2\n".encode("latin-1"))
    frame = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert frame.columns == ["name", "amount"] and {r.name for r in frame.collect()} == {"Café", "Bar"}
    assert delimited.read_grid(spark, str(tmp_path / "a.csv")).count() == 3


ODD_VALUES = ["x", "a;b", "two\nlines", 'q"uote', '"', "\n\n", "", "é", '5" pipe', "l\r\nm", 'all ";\n"" of it', "x" * 40]


@pytest.fixture
def odd_files(tmp_path):
    """Two files of quoted values, and what a plain reader says of them."""
    import csv
    import random

    draw, rows = random.Random(5), []
    for n in range(300):
        rows.append([f"r{n}", *draw.choices(ODD_VALUES, k=3)])
    for name, part in (("a.csv", rows), ("b.csv", rows[:5])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8-sig") as file:
            csv.writer(file, delimiter=";").writerows([["id", "p", "q", "r"], *part])
    return tmp_path, rows


@pytest.mark.parametrize("size", [1 << 20, 200, 41])
def test_records_across_file_splits(spark, odd_files, size):
    from ratiowatch.sources import records

    path, rows = str(odd_files[0]), odd_files[1]
    plain = sorted([tuple(v or None for v in r) for r in rows + rows[:5]], key=str)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = records.layout(spark, path, ";")
        assert found.breaks > 300 and (size > 10_000 or found.starts.count() > 3) and (size > 1000 or found.across > 0)
        grid = delimited.read_grid(spark, path).collect()
        assert sorted([tuple(r.cells) for r in grid if r.row_no], key=str) == plain
        assert [r.cells for r in sorted(grid, key=lambda r: r.row_no) if r.table_id == "a.csv"][1:] == [[v or None for v in r] for r in rows]
        frame = delimited.read_delimited(spark, path)
        assert frame.columns == ["id", "p", "q", "r"] and sorted(map(tuple, frame.collect()), key=str) == plain
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_quoted_latin_text_and_values_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,note\r\nCaf\xe9,"one\r\ntwo"\r\n\r\nB,5" pipe\r\nC,"open\r\nto the end'.encode("latin-1"))
    frame = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(tuple(r) for r in frame.collect()) == [("B", '5" pipe'), ("C", "open\r\nto the end"), ("Café", "one\r\ntwo")]
    rows = {r.row_no: r.cells for r in delimited.read_grid(spark, str(tmp_path)).collect()}
    assert rows == {0: ["name", "note"], 1: ["Café", "one\r\ntwo"], 2: ["B", '5" pipe'], 3: ["C", "open\r\nto the end"]}


def test_grid_rows_of_any_width_feed_the_statements(spark, tmp_path):
    (tmp_path / "book.csv").write_text('"All figures in Rs. Lakhs"\n\n"Company","Year","Sales","Total\nAssets"\nAcme,2024,"1,000","20"\n')
    grid = delimited.read_grid(spark, str(tmp_path))
    assert [(r.row_no, len(r.cells)) for r in grid.orderBy("row_no").collect()] == [(0, 1), (1, 4), (2, 4)]
    row = documents.wide_records(grid).first()
    assert (row.table_id, row.company_id, row.Revenue, row.Total_Assets) == ("book.csv", "Acme", 1e8, 2e6)


def test_units_count_only_above_the_header(spark):
    head = ["Company Name", "Financial Year", "Turnover"]
    tables = {"below": [head, ["Acme", "2024", "10"], ["Amounts in crores", None, None]],
              "word": [["Prepared in 2024", "thousand copies", None], head, ["Acme", "2024", "10"]],
              "first": [["Figures in lakhs", "values in crores", None], ["Amounts in thousands", None, None], head, ["Acme", "2024", "10"]],
              "none": [["thousand copies", None, None], head, ["Acme", "2024", "10"]]}
    both = None
    for name, rows in tables.items():
        both = grid(spark, rows, name) if both is None else both.unionByName(grid(spark, rows, name))
    assert {r.table_id: r.table_scale for r in documents.table_heads(both).collect()} == {"below": 1.0, "word": 1e3, "first": 1e5, "none": 1.0}
    plan = documents.table_heads(both)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "collect_list" not in plan


def customers(spark):
    rows = []
    for i in range(80):
        flagged = i % 4 == 0
        rows.append((f"MEM-{i:04d}", None if i == 3 else 18000 + i * 1250, 90000 + i * 4200 + (350000 if flagged else 0), 520 + i * 4,
                     f"2024-{i % 12 + 1:02d}-15", "Late" if flagged else "On time", ["North", "South", "West", "East"][i % 4]))
    return spark.createDataFrame(rows, "member_ref string, monthly_takehome int, open_balance int, bureau_points int, joined_on string, "
                                       "repayment_outcome string, service_zone string")


def test_customer_master_profile(spark):
    shape = typing_rules.inspect(customers(spark))
    assert typing_rules.dataset_type(shape, "customer_master") == "Mixed dataset"
    assert "member_ref" in shape.identifiers and shape.targets == ["repayment_outcome"] and shape.dates == ["joined_on"]
    assert shape.missing["monthly_takehome"] == 1
    tables = profile.profile(shape, "member_ref")
    top = tables["risk_segments"].filter("place = 1").first()
    assert (top.variable, top.group_value, top.risk_percent) == ("service_zone", "North", 100.0)
    assert tables["trends"].count() == 3 and tables["findings"].count() > 5


def test_indian_units_drive_metrics(spark):
    frame = spark.createDataFrame(
        [(2022, "₹1,00,000", "₹10,000", "5 Lakhs", "1 Thousand"), (2023, "Rs. 2 Lakhs", "Rs. 20,000", "6 Lakhs", "2 Thousand"),
         (2024, "3 Lakhs", "₹30,000", "7 Lakhs", "3 Crores")],
        "`Financial Year` int, `Annual Sales` string, PAT string, `Total Assets` string, `Cash Balance` string")
    shape = typing_rules.inspect(frame)
    assert shape.dates == ["Financial Year"] and shape.numeric == ["Annual Sales", "PAT", "Total Assets", "Cash Balance"]
    metrics = {r.metric: r.value for r in profile.financial_metrics(shape, "Financial Year").collect()}
    assert (metrics["Revenue"], metrics["Revenue growth"], metrics["Net profit"], metrics["Profit margin"]) == (200000, 0.75, 20000, 0.1)
    assert metrics["Current ratio"] is None


def test_status_is_not_assumed_to_be_a_target(spark):
    frame = spark.createDataFrame([("Active" if i % 2 else "Inactive", 20 + i) for i in range(40)], "customer_status string, age int")
    assert typing_rules.inspect(frame).targets == []


def test_infinities_are_missing(spark):
    rows = [(float("inf") if i == 0 else float(i), f"2024-01-{i % 28 + 1:02d}") for i in range(40)]
    shape = typing_rules.inspect(spark.createDataFrame(rows, "Revenue double, period string"))
    assert shape.missing["Revenue"] == 1 and shape.data.agg(F.max("Revenue")).first()[0] == 39.0


def test_header_far_down_is_found(spark):
    rows = [("t", n, [f"note {n}", None, None]) for n in range(20)]
    rows += [("t", 20, ["Company Name", "Financial Year", "Turnover"]), ("t", 21, ["Alpha", "2024", "10"])]
    grid = spark.createDataFrame(rows, "table_id string, row_no int, cells array<string>")
    assert documents.header_row(grid).first().header_row == 20


def test_quoted_separators_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;note\n"A, B, C";"one, two\nthree, four"\nD;"x, y, z"\n')
    frame = delimited.read_delimited(spark, str(tmp_path / "a.csv"))
    assert sorted((r.name, r.note) for r in frame.collect()) == [("A, B, C", "one, two\nthree, four"), ("D", "x, y, z")]


def test_shared_folder_is_cleared(spark):
    import os

    from ratiowatch import session

    table = session.cut_lineage(spark.range(3).toDF("n"))
    path = table._scratch.removeprefix("file:")
    assert table.count() == 3 and os.path.isdir(path)
    session.drop_scratch(table)
    assert not os.path.exists(path)


def test_all_levers_in_one_grid(spark):
    from ratiowatch.operators import scenarios

    grid = scenarios.grid_scenarios(list(scenarios.LEVERS))
    assert grid.size == 9600
    number = F.col("id").cast("int")
    found = spark.range(grid.size).select(grid.label(number).alias("label"), grid.change(number, "margin_change").alias("margin"))
    assert found.select("label").distinct().count() == 9600
    assert {r.margin for r in found.select("margin").distinct().collect()} == {-0.08, -0.04, 0.0, 0.04, 0.08}
