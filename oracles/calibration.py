from oracles.base import sql

AUC = """sc AS (SELECT p, sum(label) AS pos, count(*)-sum(label) AS neg FROM pairs GROUP BY 1),
rk AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below,
  sum(pos) OVER (ORDER BY p DESC) AS cp, sum(pos+neg) OVER (ORDER BY p DESC) AS ca FROM sc),
auc AS (SELECT round(sum(pos*below+pos*neg*0.5::DOUBLE)/(sum(pos)::DOUBLE*sum(neg)),6) AS roc_auc,
  round(sum(pos*cp/ca)/sum(pos),6) AS pr_auc FROM rk)"""
BIN = "CAST(ceil(p*600/60)-1 AS INT)"
BIN = "(" + "+".join(f"CAST(p>{e}/10::DOUBLE AS INT)" for e in range(1, 10)) + ")"


def bands(x, cut):
    m, h, c = cut
    return (f"CASE WHEN {x} IS NULL THEN 'Insufficient Data' WHEN {x}>={c}::DOUBLE THEN 'Critical Risk' "
            f"WHEN {x}>={h}::DOUBLE THEN 'High Risk' WHEN {x}>={m}::DOUBLE THEN 'Moderate Risk' ELSE 'Low Risk' END")


def dist(name, source, x, cut):
    return f"""{name} AS (SELECT c.risk_category, count(b.bd) AS records,
  round(count(b.bd)*100::DOUBLE/(SELECT count(*) FROM {source}),6) AS share_percent
  FROM (SELECT unnest(['Low Risk','Moderate Risk','High Risk','Critical Risk','Insufficient Data']) AS risk_category) c
  LEFT JOIN (SELECT {bands(x, cut)} AS bd FROM {source}) b ON b.bd=c.risk_category GROUP BY 1)"""


SQL = {
    "scored_pairs": sql("pairs", "SELECT loan_id, p, label AS y FROM pairs"),
    "calibration_table": sql("pairs", f"""SELECT CAST(b*10 AS VARCHAR)||'%-'||CAST((b+1)*10 AS VARCHAR)||'%' AS band,
      b/10::DOUBLE AS lower, (b+1)/10::DOUBLE AS upper, count(*) AS records, round(avg(p)*100,6) AS predicted_percent,
      round(avg(label)*100,6) AS observed_percent, round((avg(p)-avg(label))*100,6) AS gap
      FROM (SELECT *, {BIN} AS b FROM pairs) GROUP BY b"""),
    "reliability": sql("pairs", f"""SELECT count(*) AS records, avg(label) AS observed_rate, round(avg(p),6) AS predicted_rate,
      round(avg((p-label)*(p-label)),6) AS brier_score,
      (SELECT round(sum(abs(a-o)*n)/sum(n),6) FROM (SELECT avg(p) AS a, avg(label) AS o, count(*) AS n FROM pairs GROUP BY {BIN}))
        AS calibration_error,
      round(avg(label) FILTER (p>=0.5)/avg(label),6) AS lift, (SELECT roc_auc FROM auc) AS roc_auc FROM pairs""", AUC),
    "threshold_table": sql("pairs", """SELECT c AS cutoff, count(*) FILTER (p>=c) AS flagged,
      count(*) FILTER (p>=c)/count(*) AS flagged_share,
      sum(label) FILTER (p>=c)/nullif(count(*) FILTER (p>=c),0) AS precision,
      coalesce(sum(label) FILTER (p>=c),0)/greatest(sum(label),1) AS recall,
      sum(label) FILTER (p>=c)/nullif(count(*) FILTER (p>=c),0)/(sum(label)/count(*)) AS precision_over_base
      FROM pairs, (SELECT unnest([0.3,0.4,0.5,0.6,0.7]::DOUBLE[]) AS c) GROUP BY c"""),
    "band_distribution": sql("risk", "SELECT * FROM d", dist("d", "risk", "(ix/100)", ("0.2", "0.4", "0.7"))),
    "band_shift": sql("pairs", """SELECT t.risk_category, t.records AS tuned_records, t.share_percent AS tuned_share,
      d.records AS default_records, d.share_percent AS default_share, t.records-d.records AS change
      FROM t JOIN d USING (risk_category)""", dist("t", "pairs", "p", ("0.15", "0.35", "0.6")) + ","
                      + dist("d", "pairs", "p", ("0.2", "0.4", "0.7"))),
    "binary_metrics": sql("pairs", """SELECT (tp+n-tp-fp-fn)/n AS accuracy, coalesce(tp/nullif(tp+fp,0),0::DOUBLE) AS precision,
      coalesce(tp/nullif(tp+fn,0),0::DOUBLE) AS recall, coalesce(2*tp/nullif(2*tp+fp+fn,0),0::DOUBLE) AS f1, roc_auc, pr_auc
      FROM (SELECT count(*) AS n, count(*) FILTER (p>=0.5 AND label=1) AS tp, count(*) FILTER (p>=0.5 AND label=0) AS fp,
        count(*) FILTER (p<0.5 AND label=1) AS fn FROM pairs), auc""", AUC),
    "fairness": sql("pairs", """SELECT segment AS group_value, count(*) AS n, avg(label) AS positive_label_rate,
      avg(CASE WHEN p>=0.5 THEN 1 ELSE 0 END) FILTER (label=1) AS true_positive_rate,
      avg(CASE WHEN p>=0.5 THEN 1 ELSE 0 END) FILTER (label=0) AS false_positive_rate FROM pairs GROUP BY 1"""),
}
