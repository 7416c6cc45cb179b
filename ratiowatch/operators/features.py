"""Validated statements, bounded ratios, growth, early-warning flags and the rule index.

Everything here is a projection over one row plus a single window per company, so a
whole portfolio is scored in one pass after one shuffle on the company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratiowatch.functions import bands, ratios
from ratiowatch.operators import ordered
from ratiowatch.schema import CORE_FIELDS, FINANCIAL_COLUMNS, MODEL_CORE_FIELDS, RATIO_COLUMNS

C = F.col

# Flag names in display order.
FLAGS = {
    "Rapid revenue decline": "flag_revenue_decline",
    "Increasing leverage": "flag_leverage",
    "Falling liquidity": "flag_liquidity",
    "Deteriorating margins": "flag_margins",
    "Negative operating cash flow": "flag_cash_flow",
    "Increasing receivable days": "flag_receivable_days",
    "Falling interest coverage": "flag_coverage",
}
# Points of the transparent index.
RULE_WEIGHTS = {
    "Negative Equity": 0.20, "Debt / Equity": 0.16, "Current Ratio": 0.22, "Debt / Assets": 0.18,
    "Net Profit Margin": 0.15, "Return on Assets": 0.10, "Interest Coverage": 0.12,
    "Revenue Growth": 0.12, "Operating Cash Flow": 0.15,
}
CURRENT_RATIO_MINOR_WEIGHT = 0.10
PROTECTION_STEP, PROTECTION_LIMIT = 0.04, 0.20
PRIOR_RATIOS = ("Debt_to_Assets", "Current_Ratio", "EBITDA_Margin", "Receivable_Days", "Interest_Coverage")


def complete_columns(frame: DataFrame, columns=FINANCIAL_COLUMNS) -> DataFrame:
    """Missing canonical columns become all-null doubles; present ones finite doubles."""
    present = set(frame.columns)
    others = [C(name) for name in frame.columns if name not in columns]
    numbers = [(ratios.finite(C(name)) if name in present else F.lit(None).cast("double")).alias(name)
               for name in columns]
    return frame.select(*others, *numbers)


def validate_statements(frame: DataFrame) -> DataFrame:
    """Reject a table without rows, known measures or usable numbers; else clean numbers."""
    present = [name for name in FINANCIAL_COLUMNS if name in frame.columns]
    if not present:
        raise ValueError("No recognised financial column; include one such as Revenue or Total_Assets.")
    cleaned = frame.withColumns({name: ratios.finite(C(name)) for name in present})
    totals = cleaned.agg(F.count(F.lit(1)).alias("rows"),
                         *[F.count(name).alias(name) for name in present]).first()
    if totals["rows"] == 0:
        raise ValueError("The dataset has no rows.")
    if not any(totals[name] for name in present):
        raise ValueError("The recognised financial columns contain no usable numbers.")
    return cleaned


def ratio_expressions(of=C) -> dict[str, Column]:
    """Ratio formulas over ``of(measure)``, so scenarios can supply adjusted measures."""
    equity = of("Total_Assets") - of("Total_Liabilities")
    pairs = {
        "Current_Ratio": (of("Current_Assets"), of("Current_Liabilities")),
        "Quick_Ratio": (of("Current_Assets") - of("Inventory"), of("Current_Liabilities")),
        "Debt_to_Equity": (of("Debt"), equity),
        "Debt_to_Assets": (of("Debt"), of("Total_Assets")),
        "Interest_Coverage": (of("EBITDA"), of("Interest_Expense")),
        "ROA": (of("Net_Profit"), of("Total_Assets")),
        "ROE": (of("Net_Profit"), equity),
        "EBITDA_Margin": (of("EBITDA"), of("Revenue")),
        "Net_Profit_Margin": (of("Net_Profit"), of("Revenue")),
        "Operating_Cash_Flow_Ratio": (of("Cash_Flow_Operations"), of("Current_Liabilities")),
    }
    result = {name: ratios.bounded_ratio(*pair) for name, pair in pairs.items()}
    result["Receivable_Days"] = ratios.day_ratio(of("Accounts_Receivable"), of("Revenue"))
    result["Inventory_Days"] = ratios.day_ratio(of("Inventory"), of("Revenue"))
    return result


def growth_from_prior(revenue: Column, prior: Column) -> Column:
    """Relative change; a zero prior gives the limit with the sign of the new value."""
    return (F.when(prior != 0, revenue / prior - 1)
            .when((prior == 0) & (revenue > 0), 10.0).when((prior == 0) & (revenue < 0), -10.0))


def engineer_features(frame: DataFrame, unbounded_history: bool = False) -> DataFrame:
    """Every input column, the ratios, the final growth and ``prior_*`` values.

    ``unbounded_history=False`` uses one window per company and suits panels with one
    row per company and period, where a company cannot have more rows than there are
    reporting dates. Set it for raw tables where one company may hold any share of the
    rows; the history is then cut into ordered slices.
    """
    data = complete_columns(frame).withColumns(ratio_expressions())
    wanted = ["Revenue", *PRIOR_RATIOS]
    if "company_id" in data.columns and "period" in data.columns:
        data = data.withColumn("period", C("period").cast("string").try_cast("date"))
        if unbounded_history:
            data = ordered.prior_values(data, "company_id", ["period", "record_id"], ["period", *wanted])
        else:
            history = Window.partitionBy("company_id").orderBy(C("period").asc_nulls_last(), C("record_id"))
            data = data.select("*", *[F.lag(name).over(history).alias(f"prior_{name}")
                                      for name in ["period", *wanted]])
        growth = F.coalesce(C("Sales_Growth"), growth_from_prior(C("Revenue"), C("prior_Revenue")))
    else:
        data = data.withColumns({f"prior_{name}": F.lit(None).cast("double") for name in wanted})
        growth = C("Sales_Growth")
    return data.withColumn("Sales_Growth", ratios.clip(growth, -10.0, 10.0))


def early_warnings(features: DataFrame) -> DataFrame:
    """Seven boolean flags, the list of active ones and their count."""
    prior = {name: C(f"prior_{name}") for name in PRIOR_RATIOS}

    def fired(*conditions: Column) -> Column:
        combined = F.lit(False)
        for condition in conditions:
            combined = combined | F.coalesce(condition, F.lit(False))
        return combined

    rules = {
        "Rapid revenue decline": fired(C("Sales_Growth") <= -0.15),
        "Increasing leverage": fired(C("Debt_to_Assets") >= 0.65,
                                     C("Debt_to_Assets") > prior["Debt_to_Assets"] + 0.05),
        "Falling liquidity": fired(C("Current_Ratio") < 1.0, C("Current_Ratio") < prior["Current_Ratio"] * 0.9),
        "Deteriorating margins": fired(C("EBITDA_Margin") < 0, C("Net_Profit_Margin") < 0,
                                       C("EBITDA_Margin") < prior["EBITDA_Margin"]),
        "Negative operating cash flow": fired(C("Cash_Flow_Operations") < 0),
        "Increasing receivable days": fired(C("Receivable_Days") > 90,
                                            C("Receivable_Days") > prior["Receivable_Days"] + 10),
        "Falling interest coverage": fired(C("Interest_Coverage") < 1.5,
                                           C("Interest_Coverage") < prior["Interest_Coverage"]),
    }
    flagged = features.withColumns({FLAGS[name]: rule for name, rule in rules.items()})
    active = F.filter(F.array(*[F.when(C(column), F.lit(name)) for name, column in FLAGS.items()]),
                      lambda item: item.isNotNull())
    return flagged.withColumn("warnings", active).withColumn(
        "warning_signals", F.size("warnings").cast("bigint"))


def observed_fields(of=C) -> Column:
    return ratios.present_count([of(name) for name in CORE_FIELDS])


def model_eligible() -> Column:
    return (observed_fields() >= 4) & (ratios.present_count([C(n) for n in MODEL_CORE_FIELDS]) >= 2)


def derived_equity(frame: DataFrame) -> Column:
    """Reported equity, else assets less liabilities, else assets less debt."""
    parts = [C("Total_Assets") - C("Total_Liabilities"), C("Total_Assets") - C("Debt")]
    if "Equity_Value" in frame.columns:
        parts.insert(0, ratios.finite(C("Equity_Value")))
    return F.coalesce(*parts)


def debt_to_equity(frame: DataFrame) -> Column:
    return F.coalesce(C("Debt_to_Equity"), ratios.safe_ratio(C("Debt"), derived_equity(frame)))


def rule_conditions(debt_equity: Column, of=C) -> tuple[dict[str, Column], dict[str, Column]]:
    risky = {
        "Negative Equity": debt_equity < 0,
        "Debt / Equity": debt_equity > 2,
        "Current Ratio": of("Current_Ratio") < 1.2,
        "Debt / Assets": of("Debt_to_Assets") >= 0.65,
        "Net Profit Margin": of("Net_Profit_Margin") < 0,
        "Return on Assets": of("ROA") < 0,
        "Interest Coverage": of("Interest_Coverage") < 1.5,
        "Revenue Growth": of("Sales_Growth") < -0.15,
        "Operating Cash Flow": of("Cash_Flow_Operations") < 0,
    }
    protective = {
        "Current Ratio": of("Current_Ratio") >= 1.5,
        "Debt / Equity": (debt_equity >= 0) & (debt_equity <= 2),
        "Net Profit Margin": of("Net_Profit_Margin") >= 0,
        "Return on Assets": of("ROA") >= 0,
        "Interest Coverage": of("Interest_Coverage") >= 1.5,
        "Revenue Growth": of("Sales_Growth") > 0,
        "Operating Cash Flow": of("Cash_Flow_Operations") > 0,
    }
    return risky, protective


def _names_where(conditions: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in conditions.items()]),
                    lambda item: item.isNotNull())


def rule_points(risky: dict[str, Column], of=C) -> Column:
    """Sum of the weights of the fired rules; the current ratio has two tiers."""
    score = F.lit(0.0)
    for name, condition in risky.items():
        points = F.lit(RULE_WEIGHTS[name])
        if name == "Current Ratio":
            points = F.when(of("Current_Ratio") < 1.0, points).otherwise(F.lit(CURRENT_RATIO_MINOR_WEIGHT))
        score = score + F.when(condition, points).otherwise(F.lit(0.0))
    return score


def index_from(points: Column, protective: Column, observed: Column) -> Column:
    relief = F.least(F.lit(PROTECTION_LIMIT), protective * F.lit(PROTECTION_STEP))
    return F.when(observed >= 2, ratios.clip(points - relief, 0.0, 1.0) * 100)


def risk_index(features: DataFrame) -> DataFrame:
    """The transparent 0-100 index with its band, drivers and protective factors."""
    data = features.withColumn("debt_equity_used", debt_to_equity(features))
    risky, protective = rule_conditions(C("debt_equity_used"))
    data = data.withColumns({
        "rule_risk_score": rule_points(risky),
        "risk_drivers": _names_where(risky),
        "protective_factors": _names_where(protective),
        "observed_core_fields": observed_fields(),
    })
    index = index_from(C("rule_risk_score"), F.size("protective_factors"), C("observed_core_fields"))
    return data.withColumn("risk_index", index).withColumn(
        "risk_category", bands.risk_band3(C("risk_index") / 100))


def screen(statements: DataFrame, unbounded_history: bool = False) -> DataFrame:
    """Every record scored, banded, covered and flagged in one plan."""
    scored = risk_index(early_warnings(engineer_features(statements, unbounded_history)))
    return scored.withColumns({
        "method": F.when(C("risk_index").isNull(), "Insufficient data").otherwise("Rule-based risk index"),
        "health_score": ratios.clip(F.lit(100.0) - C("risk_index"), 0.0, 100.0),
        "data_coverage": C("observed_core_fields"),
        "coverage_percent": C("observed_core_fields") / F.lit(float(len(CORE_FIELDS))) * 100,
    })
