from oracles.base import CORE, RATIOS, joined, present, sql

FLAG_NAMES = ["Rapid revenue decline", "Increasing leverage", "Falling liquidity", "Deteriorating margins",
              "Negative operating cash flow", "Increasing receivable days", "Falling interest coverage"]
FLAG_COLS = ["flag_revenue_decline", "flag_leverage", "flag_liquidity", "flag_margins", "flag_cash_flow",
             "flag_receivable_days", "flag_coverage"]
WARN = joined([(n, f"f{i}") for i, n in enumerate(FLAG_NAMES, 1)])
RISKY = [("Negative Equity", "de<0"), ("Debt / Equity", "de>2"), ("Current Ratio", "Current_Ratio<1.2::DOUBLE"),
         ("Debt / Assets", "Debt_to_Assets>=0.65::DOUBLE"), ("Net Profit Margin", "Net_Profit_Margin<0"),
         ("Return on Assets", "ROA<0"), ("Interest Coverage", "Interest_Coverage<1.5::DOUBLE"),
         ("Revenue Growth", "Sales_Growth < -0.15::DOUBLE"), ("Operating Cash Flow", "Cash_Flow_Operations<0")]
PROT = joined([("Current Ratio", "Current_Ratio>=1.5::DOUBLE"), ("Debt / Equity", "de>=0 AND de<=2"),
               ("Net Profit Margin", "Net_Profit_Margin>=0"), ("Return on Assets", "ROA>=0"),
               ("Interest Coverage", "Interest_Coverage>=1.5::DOUBLE"), ("Revenue Growth", "Sales_Growth>0"),
               ("Operating Cash Flow", "Cash_Flow_Operations>0")])
# Fired rules from the heaviest weight down; equal weights in rule order.
R = dict(RISKY)
TOP = joined([("Current Ratio (0.22)", "Current_Ratio<1"), ("Negative Equity (0.20)", R["Negative Equity"]),
              ("Debt / Assets (0.18)", R["Debt / Assets"]), ("Debt / Equity (0.16)", R["Debt / Equity"]),
              ("Net Profit Margin (0.15)", R["Net Profit Margin"]),
              ("Operating Cash Flow (0.15)", R["Operating Cash Flow"]),
              ("Interest Coverage (0.12)", R["Interest Coverage"]), ("Revenue Growth (0.12)", R["Revenue Growth"]),
              ("Current Ratio (0.10)", "Current_Ratio>=1 AND Current_Ratio<1.2::DOUBLE"),
              ("Return on Assets (0.10)", R["Return on Assets"])])
K = "record_id, company_id, period"
METHOD = "CASE WHEN ix IS NULL THEN 'Insufficient data' ELSE 'Rule-based risk index' END"
LABEL = "printf('%d/13 core fields (%.0f%%)', n_obs, n_obs*100::DOUBLE/13)"
EQUITY = "coalesce(Total_Assets-Total_Liabilities, Total_Assets-Debt)"


def nz(n, d):
    return f"({n})/nullif({d},0)"


EXTRA = f"""de AS debt_equity_ratio,
  coalesce(ROE, CASE WHEN abs({EQUITY})>1e-9 THEN Net_Profit/{EQUITY} END) AS return_on_equity,
  ROA AS return_on_assets, Current_Assets-Current_Liabilities AS working_capital, {EQUITY} AS equity,
  {nz('Cash_Flow_Operations','Revenue')} AS cash_flow_to_revenue,
  {nz('EBITDA','Total_Assets-Current_Liabilities')} AS roce,
  Revenue-Cost_of_Goods_Sold AS gross_profit, {nz('Revenue-Cost_of_Goods_Sold','Revenue')} AS gross_margin"""

IND = [("Rapid revenue decline", "Sales growth <= -15%", "CRITICAL", "Sales_Growth", "f1",
        "'Sales growth: '||printf('%.1f%%', Sales_Growth*100)"),
       ("Negative operating cash flow", "Operating cash flow < 0", "CRITICAL", "Cash_Flow_Operations", "f5",
        "'Operating cash flow: '||format('{:,.0f}', Cash_Flow_Operations)"),
       ("Increasing leverage", "Debt/assets >= 0.65 or +5pp vs prior", "HIGH", "Debt_to_Assets", "f2",
        "'Debt/assets: '||printf('%.2fx', Debt_to_Assets)"),
       ("Falling liquidity", "Current ratio < 1.0x or -10% vs prior", "HIGH", "Current_Ratio", "f3",
        "'Current ratio: '||printf('%.2fx', Current_Ratio)"),
       ("Deteriorating margins", "EBITDA/net margin < 0 or falling", "MEDIUM", "EBITDA_Margin", "f4",
        "'EBITDA margin: '||printf('%.1f%%', EBITDA_Margin*100)"),
       ("Increasing receivable days", "Receivable days > 90 or +10 vs prior", "MEDIUM", "Receivable_Days", "f6",
        "'Receivable days: '||printf('%.1fd', Receivable_Days)"),
       ("Falling interest coverage", "Interest coverage < 1.5x or falling", "HIGH", "Interest_Coverage", "f7",
        "'Interest coverage: '||printf('%.2fx', Interest_Coverage)")]
DETAIL = "detail AS (" + " UNION ALL ".join(
    f"""SELECT {K}, '{n}' AS indicator, CASE WHEN {col} IS NULL THEN 'Not available' ELSE {txt} END AS actual_value,
 '{t}' AS threshold, CASE WHEN {col} IS NULL THEN 'INFO' WHEN {f} THEN '{s}' ELSE 'LOW' END AS severity,
 CASE WHEN {col} IS NULL THEN 'Not assessed' WHEN {f} THEN 'Triggered' ELSE 'Not triggered' END AS status FROM flags"""
    for n, t, s, col, f, txt in IND) + ")"


def texts(pairs):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs) + "], lambda x: x IS NOT NULL)"


RECS = texts([
    ("f5 OR coalesce(Cash_Flow_Operations<0,false)", "Speed up collections and working-capital conversion to restore operating cash."),
    ("f2 OR coalesce(Debt_to_Assets>=0.65::DOUBLE,false)", "Map debt maturities and plan a measured reduction of leverage."),
    ("f3 OR coalesce(Current_Ratio<1,false)", "Match short-term obligations to available current assets."),
    ("f4 OR coalesce(Net_Profit_Margin<0,false)", "Find the cost drivers behind the weak operating and net margins."),
    ("f1", "Explain the revenue decline and refresh forecasts with verified demand.")])
CONCERN = texts([("f1", "sales are shrinking"), ("f2", "debt weighs more on assets"), ("f3", "short-term cover is thinning"),
                 ("f4", "margins are under pressure"), ("f5", "operations use up cash"),
                 ("f6", "customers pay later"), ("f7", "interest is covered less well")])
STRENGTH = texts([("Sales_Growth>0", "sales are growing"), ("Current_Ratio>=1", "current assets cover current liabilities"),
                  ("Cash_Flow_Operations>0", "operations bring in cash"),
                  ("EBITDA_Margin>0 AND NOT f4", "operations earn a margin")])
URGENT = texts([("f5", "turn operations cash-positive"), ("f2", "bring debt down relative to assets"),
                ("f4", "win back margins"), ("f3", "build up current assets")])

SQL = {
    "features": sql("features", f"SELECT {K}, {', '.join(CORE)}, Sales_Growth, {', '.join(RATIOS)} FROM features"),
    "early_warnings": sql("risk", f"SELECT {K}, " + ", ".join(f"f{i} AS {c}" for i, c in enumerate(FLAG_COLS, 1))
                          + f", {WARN} AS warnings, n_flags AS warning_signals FROM risk"),
    "risk_index": sql("risk", f"""SELECT {K}, de AS debt_equity_used, round(pts,4) AS rule_risk_score, ix AS risk_index,
      band AS risk_category, {joined(RISKY)} AS risk_drivers,
      {' + '.join(f"CAST(coalesce({c},false) AS BIGINT)" for _, c in RISKY)} AS risk_factors,
      CAST(prot AS BIGINT) AS protective_count, n_obs AS observed_core_fields FROM risk"""),
    "screening": sql("risk", f"""SELECT {K}, {METHOD} AS method, ix AS risk_index, band AS risk_category,
      health AS health_score, n_obs AS data_coverage, CAST(round(n_obs/13::DOUBLE*100) AS BIGINT) AS coverage_percent,
      n_flags AS warning_signals, {WARN} AS warnings, {joined(RISKY)} AS drivers FROM risk"""),
    "screening_summary": sql("risk", """SELECT count(*) AS records, count(ix) AS rule_records,
      count(*) FILTER (ix IS NULL) AS insufficient_records, count(*) FILTER (n_flags>0) AS flagged_records,
      round(avg(ix),6) AS mean_risk_index, round(median(ix),6) AS median_risk_index,
      count(*) FILTER (ix>=60) AS elevated_records, count(*) FILTER (band='Low Risk') AS low_records,
      count(*) FILTER (band='Moderate Risk') AS moderate_records, count(*) FILTER (band='High Risk') AS high_records
      FROM risk"""),
    "screening_ranked": sql("risk", f"""SELECT {K}, band AS risk_category, ix AS risk_index, health AS health_score,
      {METHOD} AS method, n_flags AS warning_signals FROM risk ORDER BY ix DESC NULLS LAST, record_id LIMIT 100"""),
    "banded_exposure": sql("risk", """SELECT band AS risk_category, count(*) AS records, round(sum(Debt),2) AS total_amount,
      round(avg(Debt),4) AS average_amount FROM risk WHERE Debt IS NOT NULL GROUP BY 1"""),
    "extended_ratios": sql("risk", f"""SELECT {K}, Current_Ratio, Quick_Ratio, {EXTRA}, Sales_Growth, n_obs AS coverage_count,
      {joined([(n, n + ' IS NOT NULL') for n in CORE])} AS available_fields,
      {joined([(n, n + ' IS NULL') for n in CORE])} AS missing_fields FROM risk"""),
    "assessment": sql("risk", f"""SELECT {K}, ix AS risk_index, band AS risk_category, {LABEL} AS coverage_label,
      {TOP} AS top_risk_factors, {PROT} AS protective_factors FROM risk"""),
    "record_detail": sql("risk", f"""SELECT {K}, {METHOD} AS method, ix AS risk_index, band AS risk_category,
      health AS health_score, {LABEL} AS coverage_label, {TOP} AS driver_text, {WARN} AS warnings, Current_Ratio,
      Debt_to_Assets, EBITDA_Margin, Interest_Coverage, {EQUITY} AS equity,
      {nz('EBITDA','Total_Assets-Current_Liabilities')} AS roce,
      {nz('Revenue-Cost_of_Goods_Sold','Revenue')} AS gross_margin FROM risk"""),
    "warning_details": sql("flags", """SELECT detail.*, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1
      WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END AS severity_rank, w.reason, w.action FROM detail JOIN (VALUES
      ('Rapid revenue decline', 'A steep fall of sales cuts into the cash a business makes.', 'Compare the periods and find what changed in operations.'),
      ('Negative operating cash flow', 'Operations used up cash.', 'Look at collections, stock and payment terms.'),
      ('Increasing leverage', 'Much debt leaves little room for a shock.', 'Confirm what counts as debt and when it falls due.'),
      ('Falling liquidity', 'Short-term debts are not covered by short-term assets.', 'Go through near-term payments and receipts.'),
      ('Deteriorating margins', 'Costs rise faster than prices, or prices fall.', 'Check costs and what drives the margin.'),
      ('Increasing receivable days', 'Customers pay late, so cash is tied up.', 'Go through overdue invoices.'),
      ('Falling interest coverage', 'Earnings barely pay the interest.', 'Confirm interest and the debt service schedule.')) w(indicator, reason, action)
      USING (indicator)""", DETAIL),
    "warnings_triggered": sql("flags", """SELECT record_id, indicator, severity FROM detail
      WHERE status='Triggered'""", DETAIL),
    "severity_counts": sql("flags", "SELECT severity, count(*) AS warnings FROM detail GROUP BY 1", DETAIL),
    "recommendations": sql("risk", f"""SELECT {K}, CASE WHEN len({RECS})>0 THEN array_to_string({RECS}, ' | ')
      WHEN n_obs<4 THEN 'Supply more periods and balance-sheet fields.'
      ELSE 'Keep monitoring cash flow, liquidity, profitability and leverage.' END AS recommendations FROM risk"""),
    "risk_narrative": sql("risk", f"""SELECT {K}, array_to_string(({CONCERN})[1:3], ', ') AS concerns,
      array_to_string(({STRENGTH})[1:3], ', ') AS strengths, upper(s[1:1])||s[2:]||'.' AS priority FROM (
      SELECT *, CASE WHEN len({URGENT})>0 THEN array_to_string(({URGENT})[1:2],' and ')
        ELSE 'watch cash, liquidity and debt each period' END AS s FROM risk)"""),
    "credit_context": sql("risk", f"""SELECT {K}, Revenue AS revenue, Sales_Growth AS revenue_growth, Net_Profit AS profit,
      Current_Ratio AS current_ratio, Debt_to_Assets AS debt_to_assets, EBITDA_Margin AS ebitda_margin,
      Interest_Coverage AS interest_coverage, Cash_Flow_Operations AS cash_flow_operations, ix AS risk_index,
      health AS health_score, band AS risk_category, {METHOD} AS method, {LABEL} AS coverage_label,
      n_obs/13::DOUBLE*100 AS coverage_percent, {WARN} AS warnings, {TOP} AS top_risk, {PROT} AS protective,
      p_period AS prior_period, p_rev AS prior_revenue,
      CASE WHEN p_rev<>0 THEN (Revenue-p_rev)/abs(p_rev) END AS revenue_change FROM risk"""),
    "prior_period": sql("features", f"""SELECT {K}, p_period AS prior_period, p_rev AS prior_revenue,
      CASE WHEN p_rev<>0 THEN (Revenue-p_rev)/abs(p_rev) END AS revenue_change FROM features"""),
    "prior_loan": """SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS loan_date, o_orderkey AS loan_id,
      o_totalprice AS loan_amount, lag(CAST(o_orderdate AS DATE)) OVER h AS prior_loan_date,
      lag(o_totalprice) OVER h AS prior_loan_amount FROM orders
      WINDOW h AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)""",
    "company_trend": sql("features", """SELECT company_id, period, Revenue, Current_Ratio, Debt_to_Assets,
      EBITDA_Margin, Interest_Coverage FROM features"""),
    "company_options": sql("statements", """SELECT company_id, min(record_id) AS first_record, count(*) AS periods
      FROM statements GROUP BY 1"""),
    "coverage": sql("risk", """SELECT record_id, n_obs AS observed_core_fields,
      round(n_obs/13::DOUBLE*100,6) AS coverage_percent FROM risk"""),
    "model_eligible": sql("statements", f"""SELECT record_id, ({present(CORE)}) >= 4 AND ({present(CORE[:9])}) >= 2
      AS eligible FROM statements"""),
    "validated_statements": sql("statements", f"SELECT {K}, Revenue, EBITDA, Debt FROM statements"),
}
