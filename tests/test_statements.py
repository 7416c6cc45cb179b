"""Ratios, flags and the index on small statements with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from ratiowatch.operators import assessment, features, scenarios
from ratiowatch.schema import CORE_FIELDS

MEASURES = ("Revenue", "EBITDA", "Net_Profit", "Total_Assets", "Total_Liabilities", "Current_Assets", "Current_Liabilities",
            "Cash_Flow_Operations", "Debt", "Interest_Expense", "Accounts_Receivable", "Inventory")


def table(spark, rows, names=MEASURES):
    schema = "record_id bigint, company_id string, period string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def two_rows(spark):
    return table(spark, [
        (1, "A", "2024-12-31", 1000.0, 100.0, 50.0, 500.0, 250.0, 200.0, 100.0, 25.0, 150.0, 10.0, 100.0, 50.0),
        (2, "B", "2024-12-31", 0.0, 20.0, -10.0, 400.0, 450.0, 100.0, 0.0, -5.0, 300.0, 0.0, 10.0, 20.0)])


def test_ratios_and_zero_denominators(two_rows):
    first, second = features.engineer_features(two_rows).orderBy("record_id").collect()
    assert (first.Current_Ratio, first.Quick_Ratio, first.Debt_to_Equity, first.Interest_Coverage) == (2.0, 1.5, 0.6, 10.0)
    assert second.Current_Ratio is None and second.Interest_Coverage is None and second.Debt_to_Equity == -6.0


def test_ratios_are_bounded(two_rows):
    tiny = two_rows.withColumn("Current_Liabilities", F.lit(0.001))
    assert [r.Current_Ratio for r in features.engineer_features(tiny).collect()] == [100.0, 100.0]


def test_deterioration_fires_every_flag(spark):
    data = table(spark, [
        (1, "A", "2024-12-31", 1000.0, 100.0, 50.0, 500.0, 200.0, 200.0, 100.0, 20.0, 150.0, 10.0, 100.0, 50.0),
        (2, "A", "2025-12-31", 800.0, 50.0, 20.0, 500.0, 200.0, 100.0, 100.0, -2.0, 250.0, 10.0, 240.0, 50.0)])
    last = features.early_warnings(features.engineer_features(data)).orderBy("record_id").collect()[1]
    assert last.warning_signals == 7 and list(last.warnings) == list(features.FLAGS)


@pytest.mark.parametrize("prior,now,growth", [(0.0, 5.0, 10.0), (0.0, -5.0, -10.0), (0.0, 0.0, None), (None, 5.0, None),
                                              (10.0, None, None), (10.0, 8.0, 0.8 - 1)])
def test_growth_edges(spark, prior, now, growth):
    data = table(spark, [(1, "A", "2024-12-31", prior), (2, "A", "2025-12-31", now)], ("Revenue",))
    found = features.engineer_features(data).orderBy("record_id").collect()[1].Sales_Growth
    assert found is None if growth is None else found == pytest.approx(growth)


def test_nan_infinity_and_text_become_null(spark):
    rows = [(1, "A", "x", "NaN"), (2, "A", "y", "Infinity"), (3, "A", "z", "abc"), (4, "A", "2024-01-31", "12.5")]
    raw = spark.createDataFrame(rows, "record_id bigint, company_id string, period string, Revenue string")
    found = [r.Revenue for r in features.complete_columns(raw).orderBy("record_id").collect()]
    assert found == [None, None, None, 12.5]


def test_validation_rejects_unusable_tables(spark):
    for bad in (spark.createDataFrame([("x",)], "notes string"), spark.createDataFrame([], "Revenue double"),
                spark.createDataFrame([(None,)], "Revenue double")):
        with pytest.raises(ValueError):
            features.validate_statements(bad)


def plain_index(row):
    """The rule index worked out value by value in plain Python."""
    def ratio(a, b):
        return None if a is None or b is None or abs(b) <= 1e-9 else max(-100.0, min(100.0, a / b))

    def minus(a, b):
        return None if a is None or b is None else a - b

    equity = minus(row["Total_Assets"], row["Total_Liabilities"])
    de = ratio(row["Debt"], equity)
    if de is None:
        other = equity if equity is not None else minus(row["Total_Assets"], row["Debt"])
        de = None if row["Debt"] is None or other is None or abs(other) <= 1e-9 else row["Debt"] / other
    cr, da = ratio(row["Current_Assets"], row["Current_Liabilities"]), ratio(row["Debt"], row["Total_Assets"])
    nm, roa = ratio(row["Net_Profit"], row["Revenue"]), ratio(row["Net_Profit"], row["Total_Assets"])
    ic, cfo = ratio(row["EBITDA"], row["Interest_Expense"]), row["Cash_Flow_Operations"]
    bad = good = 0.0
    if cr is not None:
        bad += 0.22 if cr < 1 else 0.10 if cr < 1.2 else 0
        good += cr >= 1.5
    if de is not None:
        bad += 0.20 if de < 0 else 0.16 if de > 2 else 0
        good += 0 <= de <= 2
    bad += 0.18 if da is not None and da >= 0.65 else 0
    for value, limit, weight in ((nm, 0, 0.15), (roa, 0, 0.10), (ic, 1.5, 0.12)):
        if value is not None:
            bad, good = (bad + weight, good) if value < limit else (bad, good + 1)
    if cfo is not None:
        bad, good = (bad + 0.15, good) if cfo < 0 else (bad, good + (cfo > 0))
    if sum(row.get(n) is not None for n in CORE_FIELDS) < 2:
        return None
    return 100 * min(1.0, max(0.0, bad - min(0.20, good * 0.04)))


def test_index_equals_row_by_row_rules_on_sparse_records(spark):
    rng = random.Random(7)
    rows = []
    for number in range(240):
        values = [rng.uniform(-500, 2000) if rng.random() > 0.35 else None for _ in MEASURES]
        rows.append((number, f"C{number}", "2024-12-31", *values))
    found = features.screen(table(spark, rows)).select("record_id", "risk_index").collect()
    for r in found:
        expected = plain_index(dict(zip(MEASURES, rows[r.record_id][3:])))
        assert (r.risk_index is None) == (expected is None)
        assert expected is None or r.risk_index == pytest.approx(expected, abs=1e-9)


def test_ranked_drivers_and_bands_partition_rows(spark, two_rows):
    screened = features.screen(two_rows)
    assessed = {r.record_id: r for r in assessment.assess(screened).collect()}
    weights = [d.weight for d in assessed[2].ranked_drivers]
    assert weights == sorted(weights, reverse=True)
    assert screened.groupBy("risk_category").count().agg(F.sum("count")).first()[0] == 2
    details = assessment.warning_details(screened)
    assert details.count() == 14 and assessment.triggered(details).count() <= 14


def test_three_lever_scenario(spark):
    row = spark.createDataFrame([(1, 1000.0, 100.0, 250.0, 0.1), (2, 0.0, 1.0, 1.0, None), (3, 5.0, 1.0, None, None)],
                                "record_id bigint, Revenue double, EBITDA double, Debt double, Sales_Growth double")
    accepted, rejected = scenarios.adjust_three(row, -0.2, -0.03, 0.1)
    moved = accepted.first()
    assert (moved.Revenue, moved.EBITDA, moved.Debt, moved.Sales_Growth) == pytest.approx((800, 56, 275, -0.12))
    assert {r.record_id: r.reason for r in rejected.collect()} == {2: "Revenue is zero", 3: "Debt is missing"}


def test_unchanged_scenario_keeps_the_baseline(spark, two_rows):
    base = scenarios.baseline(two_rows)
    same = scenarios.run_scenarios(base, scenarios.named_scenarios({"none": {}})).collect()
    assert all(r.change == 0 for r in same)
    assert scenarios.grid_scenarios(list(scenarios.LEVERS)).size == 9600
    few = scenarios.grid_scenarios(["debt_change", "revenue_change", "margin_change"], {
        "debt_change": (0, 5), "revenue_change": (-20, 0), "margin_change": (0, 4)})
    labels = spark.range(8).select(few.label(F.col("id").cast("int"))).collect()
    assert [r[0] for r in labels][:4] == ["Revenue -20%", "Revenue -20% · Operating margin +4 pp", "No change (current reported values)",
                                          "Operating margin +4 pp"]
    assert labels[7][0] == "Operating margin +4 pp · Debt +5%"
    found = scenarios.stress_summary(scenarios.run_scenarios(base, few), few).collect()
    runs = scenarios.run_scenarios(base, few).collect()
    for row in found:
        mine = [r for r in runs if r.record_id == row.record_id and r.risk_index is not None]
        worst = min(mine, key=lambda r: (-r.risk_index, r.scenario_no), default=None)
        assert row.worst_scenario == (worst and worst.scenario) and row.scenarios == 8


def test_results_do_not_depend_on_partitioning(spark, two_rows):
    def result(frame):
        return sorted(map(tuple, features.screen(frame).select("record_id", "risk_index", "warning_signals").collect()))
    assert result(two_rows.repartition(1)) == result(two_rows.repartition(50))
