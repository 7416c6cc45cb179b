from oracles.base import sql

SQL = {
    "model_roundtrip": sql("statements", "SELECT count(*) AS n_rows, CAST(0 AS DOUBLE) AS largest_difference FROM statements"),
    "grouped_folds": sql("statements", """SELECT company_id AS company, CAST(positives AS BIGINT) AS positives, n_rows,
      CAST(CASE WHEN (rn-1)%10<5 THEN (rn-1)%10 ELSE 9-(rn-1)%10 END AS INT) AS fold FROM (
      SELECT *, row_number() OVER (ORDER BY positives DESC, n_rows DESC, company_id) AS rn FROM (
      SELECT company_id, sum(label) AS positives, count(*) AS n_rows FROM lab WHERE label IS NOT NULL GROUP BY 1))""",
                         """lab AS (SELECT company_id, CASE WHEN x<0 THEN 1 WHEN x>=0 THEN 0 END AS label FROM (
      SELECT company_id, lead(Net_Profit) OVER (PARTITION BY company_id ORDER BY period, record_id) AS x FROM statements))"""),
    "holdout_split": sql("loans", """SELECT loan_status, is_test, CASE WHEN is_test THEN t ELSE n-t END AS records FROM (
      SELECT loan_status, n, CAST(round_even(n*0.25, 0) AS BIGINT) AS t FROM (SELECT loan_status, count(*) AS n FROM loans WHERE loan_status IS NOT NULL GROUP BY 1)),
      (SELECT unnest([true, false]) AS is_test) WHERE CASE WHEN is_test THEN t ELSE n-t END > 0"""),
}
