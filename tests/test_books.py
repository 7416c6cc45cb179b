"""Loan books, calibration, monitoring and tables with hand-computed answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiowatch.functions import status
from ratiowatch.operators import calibration, features, intel, monitoring, notes, portfolio, reports, tables, typing_rules


def test_equal_loans_concentration(spark):
    book = spark.createDataFrame([(f"C{i}", 100.0, 700, "Yes" if i == 5 else "No") for i in range(1, 6)],
                                 "customer_id string, loan_amount double, credit_score int, default_status string")
    rows = portfolio.portfolio_risk(book)
    m = portfolio.concentration(portfolio.borrower_exposure(rows)).first()
    assert (m.borrowers, m.total_exposure, m.herfindahl_index, m.effective_borrowers) == (5, 500.0, 0.2, 5.0)
    assert (m.largest_exposure_share, m.top_10_share) == (0.2, 1.0)
    bands = {r.risk_category: r.records for r in portfolio.exposure_by_band(rows).collect()}
    assert bands == {"Low Risk": 4, "High Risk": 1}
    assert portfolio.portfolio_summary(rows).first().observed_default_rate == 0.2
    assert set(portfolio.analyze(book)) == {"customers", "summary"}


def test_loans_roll_up_per_borrower(spark):
    book = spark.createDataFrame([("C1", 50.0), ("C1", 50.0), ("C2", 100.0), ("C3", -5.0), ("C4", None)],
                                 "customer_id string, loan_amount double")
    m = portfolio.concentration(portfolio.borrower_exposure(book)).first()
    assert (m.borrowers, m.total_exposure, m.herfindahl_index) == (2, 200.0, 0.5)
    assert [r.loans for r in portfolio.top_exposures(portfolio.borrower_exposure(book)).collect()] == [2, 1]
    with pytest.raises(ValueError):
        portfolio.borrower_exposure(book.drop("loan_amount"))


@pytest.mark.parametrize("column,values,freq,expected", [
    ("origination_date", ["2021-01-15", "2021-06-15", "2022-03-10", "2022-09-20"], "year", {"2021": 0.5, "2022": 0.0}),
    ("origination_date", ["2021-01-15", "2021-06-15", "2022-03-10", "2022-09-20"], "quarter",
     {"2021Q1": 1.0, "2021Q2": 0.0, "2022Q1": 0.0, "2022Q3": 0.0}),
    ("origination_year", ["2021", "2021", "2022", "2022"], "year", {"2021": 0.5, "2022": 0.0}),
    ("vintage", [" early ", "early", "late", ""], "year", {"early": 0.5, "late": 0.0})])
def test_vintages(spark, column, values, freq, expected):
    rows = [(f"L{i}", 100.0, v, "Yes" if i == 0 else "No") for i, v in enumerate(values)]
    book = spark.createDataFrame(rows, f"loan_id string, loan_amount double, {column} string, default_status string")
    assert {r.cohort: r.default_rate for r in portfolio.vintages(book, freq=freq).collect()} == expected


def test_row_risk_precedence(spark):
    rows = [("High", None, None, "High Risk"), (None, "Yes", 720, "High Risk"), (None, "No", None, "Low Risk"),
            ("Low", "No", 600, "Moderate Risk"), ("Medium", "No", 800, "Moderate Risk"), (None, None, 500, "High Risk"),
            (None, None, 700, "Low Risk"), (None, None, None, "Not Assessed"), ("odd", "odd", None, "Not Assessed"),
            ("no default", None, None, "Low Risk")]
    book = spark.createDataFrame([r[:3] + (i,) for i, r in enumerate(rows)],
                                 "risk_status string, default_status string, credit_score int, n int")
    found = portfolio.portfolio_risk(book).orderBy("n").collect()
    assert [r.portfolio_risk_category for r in found] == [r[3] for r in rows]
    assert found[7].risk_basis == "No recognized risk value was available"


@pytest.mark.parametrize("text,expected", [
    ("Yes", True), ("charged-off", True), ("90 days past due", True), ("Fully_Paid", False), ("non-default", False),
    ("Current (30)", False), ("unpaid", None), ("", None), (None, None), ("1.0", True), ("0.0", False), ("pending", None)])
def test_observed_default_words(spark, text, expected):
    row = spark.createDataFrame([(text,)], "s string").select(status.observed_default(F.col("s")).alias("d")).first()
    assert row.d is expected


def test_concentration_is_within_bounds_when_one_borrower_dominates(spark):
    book = spark.range(900).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("customer_id"),
                                   (F.col("id") + 1).cast("double").alias("loan_amount"))
    m = portfolio.concentration(portfolio.borrower_exposure(book)).first()
    assert 1 / m.borrowers <= m.herfindahl_index <= 1 and m.top_5_share <= m.top_10_share <= 1


def psi_of(spark, base, latest):
    def frame(v):
        return spark.createDataFrame([(float(x),) for x in v], "x double")
    return monitoring.psi(frame(base), frame(latest), ["x"]).first()


def test_psi_is_zero_on_itself_and_grows_with_shift(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 2000)
    same, near, far = (psi_of(spark, base, v).psi for v in (base, rng.normal(0.3, 1, 2000), rng.normal(2, 1, 2000)))
    assert same == 0 and same < near < far
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))[1:-1]
    other = rng.normal(0.3, 1, 500)
    a = np.bincount(np.searchsorted(edges, base, side="right"), minlength=10) / len(base)
    b = np.bincount(np.searchsorted(edges, other, side="right"), minlength=10) / len(other)
    assert psi_of(spark, base, other).psi == pytest.approx(np.sum((b - a) * np.log((b + 1e-6) / (a + 1e-6))), abs=1e-5)
    assert psi_of(spark, [1.0] * 10, base).status == "Not comparable"


def test_snapshots_count_repeats(spark):
    rows = spark.createDataFrame([(1, "a", None)] * 4 + [(1, "b", "x")] + [(2, "a", "y")], "rev int, p string, q string")
    found = {r.rev: r for r in monitoring.snapshots(rows, "rev").collect()}
    assert (found[1].records, found[1].duplicates, found[1].missing_percent) == (5, 3, 40.0)
    assert (found[2].records, found[2].duplicates) == (1, 0)


def test_stability_and_alerts(spark):
    scores = spark.createDataFrame([(1, v) for v in (10.0, 20.0, 30.0, 70.0)] + [(2, v) for v in (10.0, 20.0, 80.0, 90.0)],
                                   "rev int, risk_index double")
    stability = monitoring.prediction_stability(scores, "rev")
    assert [(r.scored_records, r.elevated_records) for r in stability.orderBy("rev").collect()] == [(4, 1), (4, 2)]
    frame = scores.select(F.col("risk_index").alias("Revenue"))
    alerts = monitoring.monitoring_alerts(monitoring.drift_report(frame, frame), stability, "rev").collect()
    assert [a.alert for a in alerts] == ["Elevated share is 25.0% higher than in the first revision"]


def test_calibration_bins_are_right_closed(spark):
    rows = [(0.0, 0), (0.1, 1), (0.10001, 0), (1.5, 1), (float("nan"), 1), (0.5, 2), (None, 0)]
    pairs = calibration.valid_pairs(spark.createDataFrame(rows, "probability double, label int"))
    table = {r.band: r.records for r in calibration.calibration_table(pairs).collect()}
    assert table == {"0%-10%": 2, "10%-20%": 1, "90%-100%": 1}
    shares = calibration.band_distribution(pairs, F.col("p")).collect()
    assert sum(r.records for r in shares) == 4 and sum(r.share_percent for r in shares) == pytest.approx(100)
    cut = {r.cutoff: r for r in calibration.threshold_table(pairs).collect()}
    assert (cut[0.5].flagged, cut[0.5].precision, cut[0.5].recall) == (1, 1.0, 0.5)


def test_tables(spark):
    zones = ["North", "South", "East", "West"]
    rows = [(f"c-{i:03d}", zones[i % 4], float(i * 10), 600 + i, None if i % 5 == 0 else f"Review {i}") for i in range(60)]
    frame = spark.createDataFrame(rows, "client_ref string, zone string, amount double, bureau_score int, notes string")
    assert tables.search(frame, "EAST").count() == 15 and tables.search(frame, " ").count() == 60
    assert tables.search(frame, "no-such").count() == 0
    assert tables.filter_values(frame, {"zone": ["North"], "notes": ["Missing"], "absent": ["x"], "amount": []}).count() == 3
    assert tables.numeric_filter_columns(frame) == ["bureau_score"]
    options = {r.variable: r.option_values for r in tables.filter_candidates(frame).collect()}
    assert options == {"zone": "East, North, South, West"}
    last = tables.page(frame, "amount", "client_ref", 99, 25)
    assert last.count() == 10 and last.first().page == 3
    assert tables.page(frame, "amount", "client_ref", 0, 25).first().page == 1
    top = tables.sort_rows(frame, "notes", "client_ref", False).collect()
    assert top[-1].notes is None and top[0].notes is not None


def test_deep_page_equals_a_sorted_list(spark):
    frame = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"))
    plain = sorted((i * 37 % 101, i) for i in range(500))[150:200]
    assert sorted(r.id for r in tables.page(frame, "v", "id", 4, 50).collect()) == sorted(i for _, i in plain)


def test_notes(spark, tmp_path):
    rows = [("  fine ", "Decline", ""), ("", "Decline", "x"), ("y" * 2001, "Decline", "x"), ("ok", "Maybe", "x")]
    frame = spark.createDataFrame(rows, "note string, decision string, author string")
    assert [r.problem for r in notes.judged_notes(frame).collect()] == [None, "empty", "too long", "unknown decision"]
    for _ in range(2):
        notes.append_notes(frame, str(tmp_path / "notes"))
    saved = spark.read.parquet(str(tmp_path / "notes")).collect()
    assert len(saved) == 2 and saved[0].author == "Analyst" and saved[0].note_id != saved[1].note_id
    assert notes.decision_counts(frame).agg(F.sum("share_percent")).first()[0] == pytest.approx(100)


def test_segment_shares(spark):
    frame = spark.createDataFrame([(i, "abc"[i % 3], "z") for i in range(9)], "n int, kind string, fixed string")
    shares = intel.segment_concentration(frame).filter("variable = 'kind'").collect()
    assert [round(r.share, 6) for r in shares] == [round(1 / 3, 6)] * 3


def test_report_tables_hold_all_rows(spark, tmp_path):
    rows = [(f"r{i}", "A" if i % 3 else "B", float(i), float(i * i % 17), "good" if i % 4 else "bad") for i in range(60)]
    shape = typing_rules.inspect(spark.createDataFrame(rows, "row_id string, kind string, amount double, measure double, status string"))
    scored = spark.createDataFrame([(f"r{i}", 0.6 if i < 3 else 0.4, i < 3, 0.0, "x") for i in range(60)],
                                   "row_id string, anomaly_score double, anomaly boolean, missing_percent double, pattern string")
    model = spark.createDataFrame([("metric", "accuracy", 0.9)], "kind string, name string, value double")
    clusters = spark.createDataFrame([("Segment 1", 60)], "segment string, records long")
    tables = reports.profile_tables(shape, "row_id", scored, clusters, model)
    reports.write_tables(tables, str(tmp_path))
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    assert read["data"].count() == read["risk_rows"].count() == 60 and read["segments"].count() == read["model"].count() == 1
    overview = read["overview"].first()
    assert (overview.n_rows, overview.anomalies, overview.duplicate_rows) == (60, 3, 0)
    assert {r.variable for r in read["means"].collect()} >= {"amount", "measure"}
    said = " ".join(r.recommendation for r in read["recommendations"].collect())
    assert "3 unusual records" in said
    bare = reports.profile_tables(shape, "row_id")
    assert bare["overview"].first().anomalies is None and not {"risk_rows", "segments", "model"} & set(bare)


def test_accepted_notes_and_triggered_warnings_are_reported(spark):
    statements = spark.createDataFrame([(1, "c", "2020-12-31", 100.0, -5.0, 80.0, 100.0), (2, "c", "2021-12-31", 50.0, -9.0, 90.0, 100.0)],
                                       "record_id long, company_id string, period string, Revenue double, EBITDA double, Debt double, Total_Assets double")
    screened = features.screen(statements.withColumn("period", F.col("period").cast("date")))
    judged = notes.judged_notes(spark.createDataFrame([("fine", "Decline", ""), ("", "Decline", "x")], "note string, decision string, author string"))
    assert [r.note for r in reports.screening_tables(screened, "Debt", judged)["notes"].collect()] == ["fine"]
    tables = reports.assessment_tables(screened)
    assert tables["statement"].count() == 2 and tables["ratios"].count() == 2 * len(reports.RATIOS)
    found = tables["warnings"].filter("record_id = 2").collect()
    assert {"Rapid revenue decline", "Deteriorating margins"} <= {r.indicator for r in found} and all(r.reason and r.action for r in found)
