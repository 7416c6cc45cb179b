from oracles.base import sql

BOOK = """book AS (SELECT *, loan_status='Default' AS dflt,
  CASE risk_status WHEN 'Critical' THEN 'High Risk' WHEN 'High' THEN 'High Risk' WHEN 'Medium' THEN 'Moderate Risk'
    WHEN 'Low' THEN 'Low Risk' ELSE 'Not Assessed' END AS r1 FROM loans),
book2 AS (SELECT *, CASE WHEN dflt THEN 'High Risk' WHEN r1='Not Assessed' THEN 'Low Risk' ELSE r1 END AS r2 FROM book),
book3 AS (SELECT *, CASE WHEN credit_score<580 THEN 'High Risk' WHEN credit_score<670 AND r2<>'High Risk' THEN 'Moderate Risk'
  ELSE r2 END AS portfolio_risk_category,
  concat_ws('; ', CASE WHEN r1<>'Not Assessed' THEN 'Reported risk status: '||risk_status END,
   CASE WHEN dflt THEN 'Observed default or delinquency status'
        WHEN r1='Not Assessed' THEN 'Observed non-default/performing status' END,
   CASE WHEN credit_score<580 THEN 'Credit score below 580'
        WHEN credit_score<670 AND r2<>'High Risk' THEN 'Credit score below 670' END) AS risk_basis FROM book2)"""
BORROWERS = """b AS (SELECT customer_id AS borrower, sum(loan_amount) AS exposure, count(*) AS loans FROM loans
  WHERE loan_amount>0 GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY exposure DESC, borrower) AS rn, sum(exposure) OVER () AS total FROM b),
metrics AS (SELECT count(*) AS borrowers, round(max(total),2) AS total_exposure,
  round(sum((exposure/total)*(exposure/total)),6) AS herfindahl_index,
  round(1/sum((exposure/total)*(exposure/total)),3) AS effective_borrowers,
  round(max(exposure)/max(total),6) AS largest_exposure_share,
  round(sum(exposure) FILTER (rn<=5)/max(total),6) AS top_5_share,
  round(sum(exposure) FILTER (rn<=10)/max(total),6) AS top_10_share FROM ranked)"""


def vintage(label):
    return f"""v AS (SELECT {label} AS cohort, count(*) AS records,
  avg(CASE WHEN loan_status='Default' THEN 1 ELSE 0 END) AS default_rate, count(*) AS observed_records,
  sum(loan_amount) AS e, avg(credit_score) AS average_credit_score FROM loans GROUP BY 1),
vint AS (SELECT cohort, records, default_rate, observed_records, round(e,2) AS exposure,
  round(e/sum(e) OVER ()*100,4) AS exposure_share_percent, average_credit_score FROM v)"""


YEAR = vintage("CAST(year(origination_date) AS VARCHAR)")
QUARTER = vintage("CAST(year(origination_date) AS VARCHAR)||'Q'||CAST(quarter(origination_date) AS VARCHAR)")
SQL = {
    "portfolio_risk": sql("loans", """SELECT loan_id, customer_id, credit_score, dflt AS observed_default,
      portfolio_risk_category, risk_basis FROM book3""", BOOK),
    "portfolio_summary": sql("loans", """SELECT count(*) AS records, count(DISTINCT customer_id) AS unique_customers,
      count(*) FILTER (dflt) AS observed_defaults, count(dflt) AS observed_coverage,
      count(*) FILTER (dflt)/count(dflt) AS observed_default_rate, avg(credit_score) AS average_credit_score,
      round(avg(loan_amount),4) AS average_loan_amount, round(sum(loan_amount),2) AS total_loan_amount,
      count(*) FILTER (portfolio_risk_category='High Risk') AS high_records,
      count(*) FILTER (portfolio_risk_category='Moderate Risk') AS moderate_records,
      count(*) FILTER (portfolio_risk_category='Low Risk') AS low_records,
      count(*) FILTER (portfolio_risk_category<>'Not Assessed') AS assessed_records FROM book3""", BOOK),
    "concentration": sql("loans", "SELECT * FROM metrics", BORROWERS),
    "top_exposures": sql("loans", """SELECT borrower, loans, round(exposure,2) AS exposure,
      round(exposure/total*100,4) AS share_percent FROM ranked WHERE rn<=10""", BORROWERS),
    "exposure_by_band": sql("loans", """SELECT portfolio_risk_category AS risk_category, count(*) AS records,
      round(sum(loan_amount),2) AS exposure, round(avg(loan_amount),4) AS average_exposure,
      round(sum(loan_amount)/(SELECT sum(loan_amount) FROM book3 WHERE loan_amount>0)*100,4) AS share_percent
      FROM book3 WHERE loan_amount>0 GROUP BY 1""", BOOK),
    "vintage_year": sql("loans", "SELECT * FROM vint", YEAR),
    "vintage_quarter": sql("loans", "SELECT * FROM vint", QUARTER),
    "portfolio_findings": sql("loans", """SELECT 'concentration' AS topic, unnest([
      'Ten largest borrowers hold '||printf('%.1f%%',top_10_share*100)||' of exposure: '||
        CASE WHEN top_10_share>=0.5 THEN 'highly concentrated' WHEN top_10_share>=0.25 THEN 'moderately concentrated'
        ELSE 'well spread' END,
      'Largest borrower holds '||printf('%.1f%%',largest_exposure_share*100),
      'About '||printf('%.1f',effective_borrowers)||' equally sized borrowers']) AS finding FROM metrics
      UNION ALL SELECT 'vintage', 'Highest observed default rate: cohort '||arg_max(cohort, default_rate)||' at '||
        printf('%.1f%%',max(default_rate)*100) FROM vint
      UNION ALL SELECT 'vintage', 'Lowest observed default rate: cohort '||arg_min(cohort, default_rate)||' at '||
        printf('%.1f%%',min(default_rate)*100) FROM vint""", BORROWERS + "," + YEAR),
    "default_status": sql("loans", """SELECT loan_id, lower(loan_status) AS status_text,
      CASE loan_status WHEN 'Default' THEN true WHEN 'Current' THEN false WHEN 'Fully Paid' THEN false END
      AS observed_default FROM loans"""),
    "risk_label": sql("loans", """SELECT loan_id, coalesce(risk_status='Critical', false) AS status_is_risk,
      coalesce(loan_status='Default', false) AS loan_is_risk FROM loans"""),
    "target_values": sql("loans", """SELECT loan_id, CASE WHEN loan_status='Default' THEN 1 ELSE 0 END AS target
      FROM loans"""),
}
