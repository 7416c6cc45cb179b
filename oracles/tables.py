from oracles import records
from oracles.base import sql

COLS = ["loan_id", "customer_id", "loan_amount", "credit_score", "origination_date", "loan_status", "risk_status", "segment",
        "country", "region"]
NOTE = r"""nt AS (SELECT conv_id, turn, coalesce(nullif(trim(role),''),'Analyst') AS author,
  CASE conv_id%6 WHEN 0 THEN 'Pending review' WHEN 1 THEN 'Approve with monitoring' WHEN 2 THEN 'Approve with conditions'
  WHEN 3 THEN 'Refer to committee' WHEN 4 THEN 'Decline' ELSE 'Maybe' END AS decision,
  regexp_replace(coalesce(text,''),'^\s+|\s+$','','g') AS note FROM conversations),
jd AS (SELECT *, CASE WHEN note='' THEN 'empty' WHEN length(note)>2000 THEN 'too long' WHEN decision='Maybe' THEN 'unknown decision' END
  AS problem FROM nt)"""
OPTIONS = "opt AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS variable, coalesce({c},'Missing') AS v FROM loans"
    for c in ("loan_status", "risk_status", "segment", "country", "region")) + ")"
SQL = {
    "table_search": sql("loans", "SELECT loan_id, segment FROM loans WHERE contains(lower(concat_ws(' ', "
                        + ", ".join(f"coalesce(CAST({c} AS VARCHAR),'')" for c in COLS) + ")), 'build')"),
    "table_filter": sql("loans", """SELECT loan_id, risk_status, region FROM loans WHERE (risk_status IS NULL OR risk_status='High')
      AND region IN ('AFRICA','ASIA')"""),
    "table_sort": sql("loans", "SELECT loan_id, risk_status FROM loans ORDER BY risk_status DESC NULLS LAST, loan_id"),
    "table_page": sql("loans", """SELECT loan_id, loan_amount, least(7, p) AS page, p AS pages FROM (SELECT *, CAST(ceil(count(*) OVER ()/25) AS INT) AS p,
      row_number() OVER (ORDER BY loan_amount DESC, loan_id) AS rn FROM loans) WHERE rn>(least(7,p)-1)*25 AND rn<=least(7,p)*25"""),
    "filter_candidates": sql("loans", """SELECT variable, count(*) AS options, string_agg(v, ', ' ORDER BY v) AS option_values,
      CAST(row_number() OVER (ORDER BY count(*) DESC, variable) AS INT) AS place FROM opt GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30""", OPTIONS),
    "numeric_bounds": sql("loans", """SELECT 'credit_score' AS variable, min(credit_score)::DOUBLE AS low, max(credit_score)::DOUBLE AS high FROM loans
      UNION ALL SELECT 'loan_amount', min(loan_amount), max(loan_amount) FROM loans"""),
    "plot_sample": sql("loans", """SELECT loan_id, loan_amount, credit_score FROM loans
      ORDER BY md5(CAST(loan_id AS VARCHAR)||':42'), loan_id LIMIT 5000"""),
    "notes_valid": sql("", "SELECT conv_id, turn, author, decision, CAST(length(note) AS INT) AS note_length, problem FROM jd", NOTE),
    "decision_counts": sql("", """SELECT decision, count(*) AS notes, round(count(*)*100::DOUBLE/(SELECT count(*) FROM jd WHERE problem IS NULL),6)
      AS share_percent FROM jd WHERE problem IS NULL GROUP BY 1""", NOTE),
    "audit_recent": """SELECT event_id, ts AS recorded_utc, event_type AS event, props AS detail FROM events
      ORDER BY ts DESC, event_id DESC LIMIT 200""",
}
_COUNTS = (
    ("screening", "overview", records.SQL["screening_summary"], "count(*)"),
    ("screening", "bands", records.SQL["screening"], "count(DISTINCT coalesce(risk_category,''))"),
    ("screening", "records", records.SQL["screening"], "count(*)"),
    ("screening", "exposure", records.SQL["banded_exposure"], "count(*)"),
    ("screening", "notes", SQL["notes_valid"], "count(*) FILTER (problem IS NULL)"),
    ("assessment", "statement", records.SQL["screening"], "count(*)"),
    ("assessment", "ratios", records.SQL["extended_ratios"], "count(*)*17"),
    ("assessment", "assessment", records.SQL["assessment"], "count(*)"),
    ("assessment", "warnings", records.SQL["warnings_triggered"], "count(*)"),
    ("assessment", "recommendations", records.SQL["recommendations"], "CAST(sum(len(string_split(recommendations,' | '))) AS BIGINT)"))
SQL["record_reports"] = " UNION ALL ".join(
    f"SELECT '{report}' AS report, '{name}' AS table_name, (SELECT {counted} FROM ({text}) t) AS n_rows" for report, name, text, counted in _COUNTS)
