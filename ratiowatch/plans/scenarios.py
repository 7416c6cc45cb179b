"""Named scenario queries over every company-period."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratiowatch.operators import features, scenarios
from ratiowatch.sources import driver

C = F.col
GRID = ["revenue_change", "debt_change"]
WHAT_IF = {"revenue": -0.15, "profit_margin": -0.03, "debt": 0.10, "assets": -0.05, "liabilities": 0.05,
           "receivables": 0.20, "inventory": 0.10, "ocf": -0.25, "interest": 0.30}


def base(spark, sf_dir):
    return scenarios.baseline(driver.statements(spark, sf_dir))


def q_stress_grid(spark, sf_dir):
    return scenarios.run_scenarios(base(spark, sf_dir), scenarios.grid_scenarios(GRID)).select(
        "record_id", "scenario", "risk_index", "risk_category", "change")


def q_stress_presets(spark, sf_dir):
    return scenarios.run_scenarios(base(spark, sf_dir), scenarios.named_scenarios(scenarios.PRESETS)).select(
        "record_id", "scenario", "risk_index", "risk_category", "change")


def q_stress_summary(spark, sf_dir):
    grid = scenarios.grid_scenarios(GRID)
    return scenarios.stress_summary(scenarios.run_scenarios(base(spark, sf_dir), grid), grid)


def q_stress_levers(spark, sf_dir):
    return scenarios.lever_availability(driver.statements(spark, sf_dir)).drop("grid_size")


def q_scenario_levels(spark, sf_dir):
    return scenarios.lever_availability(driver.statements(spark, sf_dir)).groupBy("grid_size").agg(
        F.count(F.lit(1)).alias("records"))


def q_sensitivity(spark, sf_dir):
    return scenarios.sensitivity(base(spark, sf_dir)).orderBy(
        "record_id", C("total_impact").desc_nulls_last(), "factor")


def q_breakeven(spark, sf_dir):
    return scenarios.breakeven(base(spark, sf_dir), "revenue_change")


def q_breakeven_levers(spark, sf_dir):
    return scenarios.breakeven_levers(base(spark, sf_dir))


def q_whatif(spark, sf_dir):
    return scenarios.what_if(driver.statements(spark, sf_dir), WHAT_IF).select(
        "record_id", "Revenue", "EBITDA", "Debt", "Total_Assets", "Sales_Growth", "Current_Ratio",
        "risk_index", "risk_category", "health_score", F.array_join("warnings", ", ").alias("warnings"))


def q_scenario_three(spark, sf_dir):
    data = features.engineer_features(driver.statements(spark, sf_dir)).select(
        "record_id", "Revenue", "EBITDA", "Debt", "Sales_Growth")
    accepted, rejected = scenarios.adjust_three(data, -0.20, -0.04, 0.10)
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


QUERIES = {
    "stress_grid": q_stress_grid, "stress_presets": q_stress_presets, "stress_summary": q_stress_summary,
    "stress_levers": q_stress_levers, "scenario_levels": q_scenario_levels, "sensitivity": q_sensitivity,
    "breakeven": q_breakeven, "breakeven_levers": q_breakeven_levers, "whatif": q_whatif, "scenario_three": q_scenario_three,
}
