from oracles.base import sql


def shares(columns):
    return "lng AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, count(*) AS records FROM loans WHERE {c} IS NOT NULL "
        "GROUP BY 2" for c in columns) + """),
shr AS (SELECT variable, value, records, records/sum(records) OVER (PARTITION BY variable) AS share,
  CAST(row_number() OVER (PARTITION BY variable ORDER BY records DESC, value) AS INT) AS place FROM lng)"""


SQL = {
    "entity_risk": sql("risk", """SELECT 'riskiest' AS side, CAST(row_number() OVER (ORDER BY m DESC, e) AS INT) AS place,
      e AS entity, m AS mean_risk FROM ent QUALIFY place<=10
      UNION ALL SELECT 'strongest', CAST(row_number() OVER (ORDER BY m, e) AS INT) AS place, e, m FROM ent
      QUALIFY place<=10""", """ent AS (SELECT company_id AS e, round(avg(ix),6) AS m FROM risk GROUP BY 1
      HAVING avg(ix) IS NOT NULL)"""),
    "portfolio_mix": sql("risk", """SELECT count(DISTINCT company_id) AS entities, count(*) AS records,
      round(avg(ix),6) AS mean_risk, round(avg(health),6) AS mean_health,
      count(*) FILTER (band='High Risk')/count(*) AS high_share,
      (SELECT max(n) FROM e)/count(*) AS largest_entity_share,
      (SELECT company_id FROM e ORDER BY n DESC, company_id LIMIT 1) AS largest_entity,
      count(*) FILTER (band='Low Risk') AS low_records, count(*) FILTER (band='Moderate Risk') AS moderate_records,
      count(*) FILTER (band='High Risk') AS high_records, count(*) FILTER (band='Critical Risk') AS critical_records,
      count(*) FILTER (band='Insufficient Data') AS insufficient_records FROM risk""",
                         "e AS (SELECT company_id, count(*) AS n FROM risk GROUP BY 1)"),
    "segment_concentration": sql("loans", "SELECT * FROM shr WHERE place<=5",
                                 shares(["loan_status", "risk_status", "segment", "region"])),
    "geo_concentration": sql("loans", "SELECT * FROM shr WHERE place<=5", shares(["country", "region"])),
    "anomaly_share": sql("loans", """SELECT 'amount_outlier' AS "column",
      avg(CASE WHEN loan_amount>400000 THEN 1 ELSE 0 END) AS share FROM loans"""),
    "risk_by_period": sql("risk", """SELECT CAST(period AS VARCHAR) AS period, round(avg(ix),6) AS mean_risk,
      count(ix) AS records FROM risk GROUP BY 1"""),
}
