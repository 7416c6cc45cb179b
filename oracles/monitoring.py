from oracles.base import sql

MON = ["Revenue", "Net_Profit", "Total_Assets", "Current_Liabilities", "Debt", "Cash_Flow_Operations", "Current_Ratio",
       "Debt_to_Assets", "EBITDA_Margin", "Interest_Coverage"]
PSI = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS feature, {i} AS place, {m} AS v, year(period)<=1998 AS is_base FROM features WHERE {m} IS NOT NULL"
    for i, m in enumerate(MON)) + """),
edge AS (SELECT feature, list_sort(list_distinct(list_transform([0,1,2,3,4,5,6,7,8,9,10], lambda k: quantiles[k+1]))) AS e
  FROM (SELECT feature, quantile_cont(v, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) FILTER (is_base) AS quantiles
        FROM lv GROUP BY 1)),
bins AS (SELECT lv.feature, place, is_base, len(list_filter(e[2:len(e)-1], lambda x: x<=v)) AS b FROM lv JOIN edge USING (feature)),
cnt AS (SELECT feature, place, b, count(*) FILTER (is_base) AS nb, count(*) FILTER (NOT is_base) AS nl FROM bins GROUP BY 1,2,3),
sh AS (SELECT *, nb/sum(nb) OVER (PARTITION BY feature) AS sb, nl/sum(nl) OVER (PARTITION BY feature) AS sl FROM cnt),
psi AS (SELECT feature, place, round(sum((sl-sb)*ln((sl+1e-6::DOUBLE)/(sb+1e-6::DOUBLE))),6) AS psi FROM sh GROUP BY 1,2),
labelled AS (SELECT *, CASE WHEN psi IS NULL THEN 'Not comparable' WHEN psi>=0.25 THEN 'Significant shift'
  WHEN psi>=0.1 THEN 'Watch' ELSE 'Stable' END AS status FROM psi)"""
NULLS = "+".join(f"CAST({m} IS NULL AS INT)" for m in MON)
SHAPE = f"""shape AS (SELECT year(period)<=1998 AS is_base, count(*)::DOUBLE AS records, 11::DOUBLE AS cols,
  round(sum({NULLS})*100::DOUBLE/(count(*)*11),6) AS miss,
  (count(*)-count(DISTINCT (company_id,{','.join(MON)})))::DOUBLE AS dup FROM features GROUP BY 1),
ba AS (SELECT * FROM shape WHERE is_base), la AS (SELECT * FROM shape WHERE NOT is_base),
drift AS (SELECT 0 AS place, 'Records' AS metric, ba.records AS baseline, la.records AS current, '' AS unit, '' AS status FROM ba, la
  UNION ALL SELECT 1, 'Variables', ba.cols, la.cols, '', '' FROM ba, la
  UNION ALL SELECT 2, 'Missing cells', ba.miss, la.miss, '%', '' FROM ba, la
  UNION ALL SELECT 3, 'Duplicate records', ba.dup, la.dup, '', '' FROM ba, la
  UNION ALL SELECT place+4, 'PSI · '||feature, NULL, psi, 'PSI', status FROM labelled)"""
STAB = """stab AS (SELECT year(period) AS revision, count(ix) AS scored_records, round(avg(ix),6) AS mean_index,
  round(median(ix),6) AS median_index, count(*) FILTER (ix>=60) AS elevated_records,
  count(*) FILTER (ix>=60)/count(ix) AS elevated_share FROM risk GROUP BY 1)"""
SQL = {
    "snapshots": sql("loans", """SELECT CAST(year(origination_date) AS INT) AS revision, count(*) AS records, 10::BIGINT AS columns,
      round(sum(CAST(risk_status IS NULL AS INT)+CAST(loan_status IS NULL AS INT))*100::DOUBLE/(count(*)*10),6) AS missing_percent,
      count(*)-count(DISTINCT loan_id) AS duplicates FROM loans GROUP BY 1"""),
    "snapshot_distributions": sql("loans", """SELECT CAST(year(origination_date) AS INT) AS revision, feature, value, count(*) AS records
      FROM (SELECT origination_date, unnest(['loan_amount','credit_score']) AS feature, unnest([loan_amount::DOUBLE, credit_score::DOUBLE]) AS value FROM loans)
      WHERE value IS NOT NULL GROUP BY 1,2,3"""),
    "stored_drift": sql("features", """SELECT metric, baseline, current, unit, status, round(current-baseline,6) AS change
      FROM drift""", PSI + "," + SHAPE),
    "psi": sql("features", "SELECT feature, psi, status FROM labelled", PSI),
    "drift_report": sql("features", """SELECT metric, baseline, current, unit, status, round(current-baseline,6) AS change
      FROM drift""", PSI + "," + SHAPE),
    "prediction_stability": sql("risk", "SELECT CAST(revision AS INT) AS revision, * EXCLUDE (revision) FROM stab", STAB),
    "monitoring_alerts": sql("risk", """SELECT * FROM (
      SELECT 'Significant shift: '||string_agg(metric, ', ' ORDER BY place) AS alert FROM drift WHERE status='Significant shift'
      UNION ALL SELECT 'Moderate shift: '||string_agg(metric, ', ' ORDER BY place) FROM drift WHERE status='Watch'
      UNION ALL SELECT CASE WHEN current<>baseline THEN printf('Record count moved by %+d', CAST(current-baseline AS BIGINT)) END
        FROM drift WHERE metric='Records'
      UNION ALL SELECT CASE WHEN abs(d)>=0.05 THEN printf('Elevated share is %.1f%% %s than in the first revision', abs(d)*100,
        CASE WHEN d>0 THEN 'higher' ELSE 'lower' END) END FROM (SELECT arg_max(elevated_share,revision)-arg_min(elevated_share,revision) AS d FROM stab))
      WHERE alert IS NOT NULL""", PSI + "," + SHAPE + "," + STAB),
}
