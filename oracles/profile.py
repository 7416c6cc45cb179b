from itertools import combinations

from oracles.base import CORE, sql

# Statement columns in table order, as the profile sees them.
NUM = ["record_id", "Revenue", "EBITDA", "Net_Profit", "Total_Assets", "Total_Liabilities", "Current_Assets",
       "Current_Liabilities", "Cash_Flow_Operations", "Debt", "Interest_Expense", "Accounts_Receivable", "Inventory",
       "Cost_of_Goods_Sold"]


def longed(source, columns, name="lng"):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {i} AS place, CAST({c} AS DOUBLE) AS v FROM {source}" for i, c in enumerate(columns)) + ")"


def texted(source, columns, name="txt"):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, coalesce(CAST({c} AS VARCHAR),'Missing') AS value, count(*) AS records FROM {source} GROUP BY 2"
        for c in columns) + ")"


def pairs(columns, name="prs"):
    body = " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, '{columns[i]}' AS variable_a, '{columns[j]}' AS variable_b,
        CASE WHEN stddev_pop({columns[i]}) FILTER ({columns[j]} IS NOT NULL)>0 AND stddev_pop({columns[j]}) FILTER ({columns[i]} IS NOT NULL)>0
        THEN round(corr({columns[i]},{columns[j]}),6) END AS c FROM statements"""
        for i, j in combinations(range(len(columns)), 2))
    return f"{name} AS ({body})"


PLACES = {c: 3 if c in ("Cash_Flow_Operations", "Interest_Expense") else 0 if c == "Cost_of_Goods_Sold" else 2
          for c in NUM if c != "record_id"}
RANKS = "rks AS (SELECT variable, row_number() OVER (ORDER BY place, d DESC, o) AS r FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {p} AS place, {o} AS o, count(DISTINCT {c}) AS d FROM statements"
    for o, (c, p) in enumerate(PLACES.items())) + """)),
rp AS (SELECT CASE WHEN x.r<y.r THEN variable_a ELSE variable_b END AS va, CASE WHEN x.r<y.r THEN variable_b ELSE variable_a END AS vb,
  least(x.r,y.r) AS i, greatest(x.r,y.r) AS j, c FROM prs JOIN rks x ON x.variable=variable_a JOIN rks y ON y.variable=variable_b)"""
RANKED = list(PLACES)
LOAN_COLS = ["loan_id", "customer_id", "loan_amount", "credit_score", "origination_date", "loan_status", "risk_status",
             "segment", "country", "region"]
ROLES = {"loan_id": "", "customer_id": "customer identifier", "loan_amount": "transaction amount",
         "credit_score": "credit score", "origination_date": "date / time", "loan_status": "",
         "risk_status": "default / risk target", "segment": "", "country": "geography", "region": "geography"}
KIND = {"loan_id": "Numeric", "customer_id": "Numeric", "loan_amount": "Numeric", "credit_score": "Numeric",
        "origination_date": "Date"}
PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, '{KIND.get(c, 'Categorical')}' AS kind, count(*)-count({c}) AS missing,
    round((count(*)-count({c}))*100::DOUBLE/count(*),6) AS missing_percent, count(DISTINCT {c}) AS distinct_values,
    (SELECT string_agg(s, ', ' ORDER BY loan_id) FROM (SELECT loan_id, CAST({c} AS VARCHAR) AS s FROM loans WHERE {c} IS NOT NULL
      ORDER BY loan_id LIMIT 3)) AS sample_values, '{ROLES[c] or ('Potential ID' if c == 'loan_id' else '')}' AS meaning FROM loans"""
    for c in LOAN_COLS)
ANSWER = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, '{KIND.get(c, 'Categorical')}' AS kind, count({c}) AS filled, count(*)-count({c}) AS missing,
    count(DISTINCT {c}) AS distinct_values, """ + (
        f"""round(avg({c}),4) AS mean, round(median({c}),6) AS median, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, NULL AS most_common FROM loans"""
        if KIND.get(c) == "Numeric" else
        f"""NULL, NULL, NULL, NULL, (SELECT string_agg(value||': '||records, ', ' ORDER BY records DESC, value) FROM
        (SELECT * FROM txt WHERE variable='{c}' ORDER BY records DESC, value LIMIT 5)) FROM loans""")
    for c in LOAN_COLS)


def med(cond, expr, i, label):
    return f"SELECT {i} AS place, '{label}' AS metric, round(median(x),6) AS value FROM (SELECT {expr} AS x FROM statements) WHERE {cond}"


def quot(a, b):
    return f"({a})/nullif({b},0)"


METRICS = [("Revenue", "Revenue"), ("Revenue growth", None), ("Net profit", "Net_Profit"),
           ("Profit margin", quot("Net_Profit", "Revenue")), ("Current ratio", quot("Current_Assets", "Current_Liabilities")),
           ("Quick ratio", quot("Current_Assets-Inventory", "Current_Liabilities")),
           ("Debt-to-equity", quot("Debt", "Total_Assets-Total_Liabilities")), ("Debt-to-assets", quot("Debt", "Total_Assets")),
           ("Interest coverage", quot("EBITDA", "Interest_Expense")), ("Operating margin", quot("EBITDA", "Revenue")),
           ("Cash flow", "Cash_Flow_Operations"), ("Receivables", "Accounts_Receivable"), ("Inventory", "Inventory")]
GROWTH = """SELECT 1 AS place, 'Revenue growth' AS metric, round(median(Revenue/p-1),6) AS value FROM (SELECT Revenue,
  lag(Revenue) OVER (PARTITION BY company_id ORDER BY period, record_id) AS p FROM statements) WHERE p<>0"""
TREND = """days AS (SELECT variable, period, median(v) AS m FROM (SELECT * FROM lngd WHERE v IS NOT NULL) GROUP BY 1,2),
trend AS (SELECT variable, CAST(min(period) AS TIMESTAMP) AS from_date, CAST(max(period) AS TIMESTAMP) AS to_date,
  arg_min(m,period) AS first_value, arg_max(m,period) AS latest_value,
  round((arg_max(m,period)-arg_min(m,period))/nullif(abs(arg_min(m,period)),0)*100,6) AS change_percent,
  CASE WHEN arg_max(m,period)>arg_min(m,period) THEN 'Increasing' WHEN arg_max(m,period)<arg_min(m,period) THEN 'Declining'
  ELSE 'Stable' END AS direction FROM days GROUP BY 1 HAVING count(*)>=3)"""
LNGD = "lngd AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, period, CAST({c} AS DOUBLE) AS v FROM statements" for c in NUM[:12]) + ")"
CELLS = "+".join(f"CAST({c} IS NULL AS INT)" for c in NUM[1:])
SQL = {
    "column_types": """WITH t AS (SELECT count(*) FILTER (o_orderkey%8=7) AS blank, count(*) FILTER (o_orderkey%8=6) AS na,
        count(*) FILTER (o_orderkey%10<3) AS ch, count(*) AS n FROM orders)
      SELECT 'order_number' AS variable, 'Numeric' AS kind, 0::BIGINT AS missing UNION ALL SELECT 'booked_on','Date',0
      UNION ALL SELECT 'financial_year','Date',0
      UNION ALL SELECT 'sanctioned_amount', CASE WHEN (n-blank-na)/(n-blank)>=0.8 THEN 'Numeric' ELSE 'Categorical' END, blank+na FROM t
      UNION ALL SELECT 'channel','Categorical', ch FROM t UNION ALL SELECT 'risk_flag','Categorical',0
      UNION ALL SELECT 'remark','Categorical',0""",
    "column_roles": sql("loans", "SELECT variable, CASE WHEN n>0 THEN roles END AS roles FROM (SELECT count(*) AS n FROM loans), (VALUES "
                        + ", ".join(f"('{c}','{r}')" for c, r in ROLES.items()) + ") v(variable, roles)"),
    "identifier_columns": sql("loans", """SELECT 'loan_id' AS variable, count(DISTINCT loan_id) AS distinct_values FROM loans
      UNION ALL SELECT 'customer_id', count(DISTINCT customer_id) FROM loans"""),
    "target_columns": sql("loans", """SELECT 'loan_status' AS variable, count(DISTINCT loan_status) AS distinct_values FROM loans
      UNION ALL SELECT 'risk_status', count(DISTINCT risk_status) FROM loans"""),
    "model_features": sql("loans", " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(DISTINCT {c}) AS distinct_values, count(*)-count({c}) AS missing FROM loans
        HAVING count({c})>=0.2*count(*) AND count(DISTINCT {c})>1"""
        for c in LOAN_COLS if c not in ("loan_id", "customer_id", "loan_status"))),
    "column_profile": sql("loans", PROFILE),
    "dataset_quality": sql("loans", """SELECT count(*) AS n_rows, 10::BIGINT AS n_columns,
      round(sum(CAST(risk_status IS NULL AS INT))*100::DOUBLE/(count(*)*10),6) AS missing_percent,
      round(100::DOUBLE-sum(CAST(risk_status IS NULL AS INT))*100::DOUBLE/(count(*)*10),6) AS quality_percent,
      count(*)-(SELECT count(*) FROM (SELECT DISTINCT loan_id,customer_id,loan_amount,credit_score,origination_date,loan_status,risk_status,
        segment,country,region FROM loans)) AS duplicate_rows FROM loans"""),
    "numeric_summary": sql("", "SELECT variable, count(v) AS n, round(avg(v),4) AS mean, round(stddev_samp(v),4) AS std, min(v) AS min, "
                           + ", ".join(f"round(quantile_cont(v,{q}::DOUBLE),6) AS {n}" for n, q in
                                       (("p5", .05), ("p25", .25), ("p50", .5), ("p75", .75), ("p95", .95)))
                           + ", max(v) AS max FROM lng GROUP BY 1", longed("events", ["event_id", "user_id", "value"])),
    "categorical_summary": sql("loans", """SELECT variable, value, records, round(records*100::DOUBLE/(SELECT count(*) FROM loans),6)
      AS share_percent FROM txt QUALIFY row_number() OVER (PARTITION BY variable ORDER BY records DESC, value)<=10""",
                               texted("loans", ["loan_status", "risk_status", "segment", "country", "region"])),
    "correlations": sql("statements", """SELECT variable_a, variable_b, abs(c) AS absolute_correlation FROM prs WHERE c IS NOT NULL
      ORDER BY abs(c) DESC, i, j LIMIT 15""", pairs(NUM)),
    "correlation_matrix": sql("statements", """SELECT va AS variable_a, vb AS variable_b, c AS correlation FROM rp WHERE j<=12 AND c IS NOT NULL
      UNION ALL SELECT vb, va, c FROM rp WHERE j<=12 AND c IS NOT NULL
      UNION ALL SELECT variable, variable, 1::DOUBLE FROM rks WHERE r<=12""", pairs(RANKED) + "," + RANKS),
    "strongest_pair": sql("statements", """SELECT va AS variable_a, vb AS variable_b, abs(c) AS absolute_correlation FROM rp
      WHERE j<=10 AND c IS NOT NULL ORDER BY abs(c) DESC, i, j LIMIT 1""", pairs(RANKED) + "," + RANKS),
    "numeric_trends": sql("statements", "SELECT * FROM trend", LNGD + "," + TREND),
    "record_frequency": sql("loans", """SELECT min(m) AS from_month, max(m) AS to_month, arg_min(n,m) AS first_value,
      arg_max(n,m) AS latest_value, round((arg_max(n,m)-arg_min(n,m))/abs(arg_min(n,m))*100,6) AS change_percent,
      CASE WHEN arg_max(n,m)>arg_min(n,m) THEN 'Increasing' WHEN arg_max(n,m)<arg_min(n,m) THEN 'Declining' ELSE 'Stable' END AS direction
      FROM (SELECT strftime(origination_date,'%Y-%m') AS m, count(*) AS n FROM loans GROUP BY 1) HAVING count(*)>=3"""),
    "target_distribution": sql("loans", """SELECT coalesce(risk_status,'Missing') AS target_value, count(*) AS records,
      round(count(*)*100::DOUBLE/(SELECT count(*) FROM loans),6) AS share_percent FROM loans GROUP BY 1"""),
    "risk_segments": sql("loans", """SELECT variable, g AS group_value, n AS records, r AS risk_records, round(r*100::DOUBLE/n,6) AS risk_percent,
      CAST(row_number() OVER (PARTITION BY variable ORDER BY r*100::DOUBLE/n DESC, g) AS INT) AS place FROM seg WHERE n>=3 QUALIFY place<=3""",
                         "seg AS (" + " UNION ALL ".join(
                             f"""SELECT '{c}' AS variable, coalesce({c},'Missing') AS g, count(*) AS n,
                             count(*) FILTER (loan_status='Default') AS r FROM loans GROUP BY 2"""
                             for c in ("risk_status", "segment", "region")) + ")"),
    "top_decile_share": sql("loans", """SELECT variable, round(sum(v) FILTER (rn<=k)/sum(v),6) AS top_decile_share FROM (
      SELECT variable, v, row_number() OVER (PARTITION BY variable ORDER BY v DESC) AS rn,
        greatest(1, ceil(count(*) OVER (PARTITION BY variable)*0.1)) AS k FROM lng WHERE v IS NOT NULL) GROUP BY 1 HAVING sum(v)>0""",
                            longed("loans", ["loan_amount"])),
    "financial_metrics": sql("statements", " UNION ALL ".join(
        GROWTH if e is None else med("x IS NOT NULL", e, i, label) for i, (label, e) in enumerate(METRICS))),
    "missing_ranking": sql("statements", "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count(*)-count({c}) AS missing, round((count(*)-count({c}))*100::DOUBLE/count(*),6) AS missing_percent FROM statements"
        for c in NUM) + ") WHERE missing>0 ORDER BY missing DESC, variable LIMIT 5"),
    "column_answer": sql("loans", ANSWER, texted("loans", [c for c in LOAN_COLS if KIND.get(c) != "Numeric"])),
    "histogram": """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, least(32, greatest(8, CAST(floor(sqrt(count(*))) AS INT))) AS n FROM events)
      SELECT 'value' AS variable, CAST(least(floor((value-lo)/(hi-lo)*n), n-1) AS INT) AS bin, count(*) AS records
      FROM events, s WHERE value IS NOT NULL GROUP BY 2""",
    "median_by_category": sql("loans", " UNION ALL ".join(
        f"SELECT '{c}' AS variable, coalesce({c},'Missing') AS group_value, round(median(loan_amount),6) AS median FROM loans GROUP BY 2"
        for c in ("segment", "region", "risk_status"))),
    "category_counts": sql("loans", """SELECT variable, value, records FROM txt
      QUALIFY row_number() OVER (PARTITION BY variable ORDER BY records DESC, value)<=12""",
                           texted("loans", ["segment", "country", "risk_status"])),
    "median_series": sql("loans", " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST(origination_date AS DATE) AS day, round(median({c}),6) AS median FROM loans GROUP BY 2"
        for c in ("loan_amount", "credit_score"))),
    "balance_totals": sql("statements", """SELECT 'Assets' AS measure, round(sum(Total_Assets),2) AS total FROM statements
      UNION ALL SELECT 'Liabilities', round(sum(Total_Liabilities),2) FROM statements"""),
    "numeric_means": sql("loans", "SELECT variable, round(avg(v),4) AS mean FROM lng GROUP BY 1",
                         longed("loans", ["loan_id", "customer_id", "loan_amount", "credit_score"])),
    "profile_warnings": sql("statements", f"""SELECT severity, topic, variable, round(evidence,6) AS evidence,
      CASE topic WHEN 'Decline' THEN printf('%.1f%%', evidence) ELSE printf('%.1f%%', evidence*100) END AS shown,
      CASE topic WHEN 'Decline' THEN 'The measure fell between its first and its latest date.' WHEN 'Missing cells' THEN 'Gaps of this size can tilt every summary.'
        ELSE 'Losses or cash outflows can point to financial strain.' END AS reason,
      CASE topic WHEN 'Decline' THEN 'Compare periods and units, then look for the cause.' WHEN 'Missing cells'
        THEN 'Check the source for completeness and write down how gaps are treated.'
        ELSE 'Confirm signs and read the periods concerned in the statements.' END AS action FROM (
      SELECT CASE WHEN x>=0.4 THEN 'High' ELSE 'Medium' END AS severity, 'Missing cells' AS topic, 'all columns' AS variable, x AS evidence
        FROM (SELECT sum({CELLS})/(count(*)*16) AS x FROM statements) WHERE x>=0.2
      UNION ALL SELECT CASE WHEN change_percent<=-20 THEN 'High' ELSE 'Medium' END, 'Decline', variable, change_percent FROM trend
        WHERE direction='Declining' AND change_percent IS NOT NULL
      UNION ALL SELECT CASE WHEN x>=0.25 THEN 'High' ELSE 'Medium' END, 'Negative values', variable, x FROM (
        SELECT 'Net_Profit' AS variable, avg(CASE WHEN Net_Profit<0 THEN 1 WHEN Net_Profit>=0 THEN 0 END) AS x FROM statements UNION ALL
        SELECT 'Cash_Flow_Operations', avg(CASE WHEN Cash_Flow_Operations<0 THEN 1 WHEN Cash_Flow_Operations>=0 THEN 0 END) FROM statements) WHERE x>0)""",
                            LNGD + "," + TREND),
    "dataset_type": """SELECT 'loans' AS table_name, 'Mixed dataset' AS dataset_type, count(*) AS n_rows FROM orders
      UNION ALL SELECT 'events', 'Time series dataset', count(*) FROM events""",
    "ranked_columns": sql("loans", """SELECT 'category' AS kind, CAST(row_number() OVER (ORDER BY place, d, m)-1 AS INT) AS place, variable FROM (
        SELECT 'segment' AS variable, 0 AS place, count(DISTINCT segment) AS d, count(*)-count(segment) AS m FROM loans
        UNION ALL SELECT 'region', 1, count(DISTINCT region), 0 FROM loans
        UNION ALL SELECT 'loan_status', 2, count(DISTINCT loan_status), 0 FROM loans
        UNION ALL SELECT 'risk_status', 2, count(DISTINCT risk_status), count(*)-count(risk_status) FROM loans)
      UNION ALL SELECT 'numeric', CAST(row_number() OVER (ORDER BY d DESC)-1 AS INT), variable FROM (
        SELECT 'loan_amount' AS variable, count(DISTINCT loan_amount) AS d FROM loans
        UNION ALL SELECT 'credit_score', count(DISTINCT credit_score) FROM loans)"""),
    "profile_findings": sql("statements", f"""SELECT printf('%d rows and %d columns; %.1f%% of cells are missing.', count(*), 16,
        round(sum({CELLS})*100::DOUBLE/(count(*)*16),6)) AS finding FROM statements
      UNION ALL SELECT '14 numeric, 1 categorical and 1 date columns.'
      UNION ALL SELECT printf('%d duplicate rows.', count(*)-count(DISTINCT record_id)) FROM statements
      UNION ALL SELECT * FROM (SELECT printf('Strongest association: %s with %s (%.2f).', variable_a, variable_b, abs(c)) FROM prs WHERE c IS NOT NULL
        ORDER BY abs(c) DESC, i, j LIMIT 1)
      UNION ALL SELECT 'Trend of '||variable||': '||lower(direction) FROM trend""", pairs(NUM) + "," + LNGD + "," + TREND),
    "profile_recommendations": sql("loans", """SELECT 0 AS place, 'Complete or validate: risk_status' AS recommendation FROM loans
        HAVING count(*)-count(risk_status) >= 0.2*count(*)
      UNION ALL SELECT 1, 'Review missing values before use.' FROM loans
        HAVING count(*)-count(risk_status) < 0.2*count(*) AND count(*) > least(count(risk_status), count(loan_status))
      UNION ALL SELECT 2, 'Confirm the meaning of: customer_id, loan_amount, credit_score, origination_date, risk_status'
      UNION ALL SELECT 5, 'Look into the decline of: '||array_to_string(list(variable ORDER BY variable)[1:5], ', ') FROM (
        SELECT variable, median(value) FILTER (d=lo) AS first, median(value) FILTER (d=hi) AS latest FROM (
          SELECT origination_date AS d, min(origination_date) OVER () AS lo, max(origination_date) OVER () AS hi,
            unnest(['loan_id','customer_id','loan_amount','credit_score']) AS variable,
            unnest([loan_id::DOUBLE, customer_id::DOUBLE, loan_amount::DOUBLE, credit_score::DOUBLE]) AS value FROM loans) GROUP BY variable)
        WHERE latest<first HAVING count(*)>0
      UNION ALL SELECT 6, text FROM (SELECT printf('Review %s = %s: %.1f%% of its records carry a risk label.', variable, value, 100*avg(bad)) AS text
        FROM (SELECT (coalesce(loan_status,'')='Default')::INT AS bad, unnest(['segment','region','risk_status']) AS variable,
          unnest([segment, region, coalesce(risk_status,'Missing')]) AS value FROM loans) GROUP BY variable, value HAVING count(*)>=3
        ORDER BY avg(bad) DESC, variable, value LIMIT 1)"""),
}
