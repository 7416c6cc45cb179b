from oracles.base import CORE, joined, present, ratio, days, sql
from oracles.records import FLAG_NAMES


def band4(x):
    return (f"CASE WHEN {x} IS NULL THEN 'Insufficient Data' WHEN {x}>=70 THEN 'Critical Risk' "
            f"WHEN {x}>=40 THEN 'High Risk' WHEN {x}>=20 THEN 'Moderate Risk' ELSE 'Low Risk' END")


def scored(source, out="stressed"):
    """Ratios, points and index over adjusted rows that keep the measure names."""
    return f"""{out}_r AS (SELECT *,
  {ratio('Current_Assets','Current_Liabilities')} AS Current_Ratio, {ratio('Debt','Total_Assets')} AS Debt_to_Assets,
  coalesce({ratio('Debt','(Total_Assets-Total_Liabilities)')},
    CASE WHEN abs(coalesce(Total_Assets-Total_Liabilities,Total_Assets-Debt))>1e-9
      THEN Debt/coalesce(Total_Assets-Total_Liabilities,Total_Assets-Debt) END) AS de,
  {ratio('EBITDA','Interest_Expense')} AS Interest_Coverage, {ratio('Net_Profit','Total_Assets')} AS ROA,
  {ratio('EBITDA','Revenue')} AS EBITDA_Margin, {ratio('Net_Profit','Revenue')} AS Net_Profit_Margin,
  {days('Accounts_Receivable')} AS Receivable_Days, {present(CORE)} AS n_obs,
  CASE WHEN Growth_In IS NOT NULL THEN least(greatest(Growth_In,-10::DOUBLE),10::DOUBLE) END AS G FROM {source}),
{out}_p AS (SELECT *,
  0::DOUBLE + CASE WHEN de<0 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN de>2 THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN Current_Ratio<1 THEN 0.22::DOUBLE WHEN Current_Ratio<1.2::DOUBLE THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN Debt_to_Assets>=0.65::DOUBLE THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN Net_Profit_Margin<0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN ROA<0 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN Interest_Coverage<1.5::DOUBLE THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN G < -0.15::DOUBLE THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN Cash_Flow_Operations<0 THEN 0.15::DOUBLE ELSE 0 END AS pts,
  CAST(coalesce(Current_Ratio>=1.5::DOUBLE,false) AS INT)+CAST(coalesce(de>=0 AND de<=2,false) AS INT)
  +CAST(coalesce(Net_Profit_Margin>=0,false) AS INT)+CAST(coalesce(ROA>=0,false) AS INT)
  +CAST(coalesce(Interest_Coverage>=1.5::DOUBLE,false) AS INT)+CAST(coalesce(G>0,false) AS INT)
  +CAST(coalesce(Cash_Flow_Operations>0,false) AS INT) AS prot FROM {out}_r),
{out} AS (SELECT *, CASE WHEN n_obs>=2 THEN
  least(greatest(pts-least(0.20::DOUBLE,prot*0.04::DOUBLE),0::DOUBLE),1::DOUBLE)*100 END AS sx FROM {out}_p)"""


def adjust(scen):
    return f"""shocked AS (SELECT record_id, ix AS base_index, z.*, Revenue*(1+rc) AS Revenue,
  Revenue*(1+rc)*(EBITDA/nullif(Revenue,0)+mc) AS EBITDA, Net_Profit, Total_Assets, Total_Liabilities, Current_Assets,
  Current_Liabilities*(1+cc) AS Current_Liabilities, Cash_Flow_Operations, Debt*(1+dc) AS Debt,
  Interest_Expense*(1+ic) AS Interest_Expense, Accounts_Receivable*(1+ac) AS Accounts_Receivable, Inventory,
  Cost_of_Goods_Sold, (1+Sales_Growth)*(1+rc)-1 AS Growth_In FROM risk CROSS JOIN {scen} z)"""


D = "::DOUBLE"
GRID = """scen AS (SELECT r/100::DOUBLE AS rc, 0::DOUBLE AS mc, d/100::DOUBLE AS dc, 0::DOUBLE AS ic, 0::DOUBLE AS cc,
  0::DOUBLE AS ac, CASE WHEN r=0 AND d=0 THEN 'No change (current reported values)'
  ELSE concat_ws(' · ', CASE WHEN r<>0 THEN 'Revenue '||printf('%+d%%',r) END, CASE WHEN d<>0 THEN 'Debt '||printf('%+d%%',d) END)
  END AS scenario, ri*5+di AS no
  FROM (SELECT unnest([-30,-20,-10,0,10,20]) AS r, generate_subscripts([-30,-20,-10,0,10,20],1)-1 AS ri) a,
       (SELECT unnest([-20,-10,0,10,20]) AS d, generate_subscripts([-20,-10,0,10,20],1)-1 AS di) b)"""
PRESETS = """scen(scenario,no,rc,mc,dc,ic,cc,ac) AS (SELECT col0, col1, col2::DOUBLE, col3::DOUBLE, col4::DOUBLE, col5::DOUBLE,
  col6::DOUBLE, col7::DOUBLE FROM (VALUES ('Mild downturn',0,-0.10,-0.02,0,0,0,0), ('Revenue shock',1,-0.20,-0.04,0.10,0,0,0),
  ('Rate and liquidity shock',2,-0.05,-0.02,0.05,0.50,0.20,0), ('Severe combined',3,-0.30,-0.08,0.20,1.00,0.40,0.30)))"""
ENDS = """scen(factor,side,rc,mc,dc,ic,cc,ac) AS (SELECT col0, col1, col2::DOUBLE, col3::DOUBLE, col4::DOUBLE, col5::DOUBLE,
  col6::DOUBLE, col7::DOUBLE FROM (VALUES ('Revenue','d',-0.3,0,0,0,0,0),('Revenue','u',0.2,0,0,0,0,0),
  ('Operating margin','d',0,-0.08,0,0,0,0),('Operating margin','u',0,0.08,0,0,0,0),('Debt','d',0,0,-0.2,0,0,0),('Debt','u',0,0,0.2,0,0,0),
  ('Interest cost','d',0,0,0,-0.5,0,0),('Interest cost','u',0,0,0,1,0,0),('Current liabilities','d',0,0,0,0,-0.2,0),
  ('Current liabilities','u',0,0,0,0,0.4,0),('Receivables','d',0,0,0,0,0,-0.3),('Receivables','u',0,0,0,0,0,0.1)))"""
STEPS = """scen AS (SELECT s::DOUBLE AS step, s/100::DOUBLE AS rc, 0::DOUBLE AS mc, 0::DOUBLE AS dc, 0::DOUBLE AS ic, 0::DOUBLE AS cc, 0::DOUBLE AS ac
  FROM (SELECT unnest([-30,-20,-10]) AS s))"""
MOVES = "scen AS (SELECT s::DOUBLE AS step, factor, " + ", ".join(
    f"CASE WHEN factor='{n}' THEN s/100::DOUBLE ELSE 0 END AS {c}" for n, c in (
        ("Revenue", "rc"), ("Operating margin", "mc"), ("Debt", "dc"), ("Interest cost", "ic"), ("Current liabilities", "cc"), ("Receivables", "ac"))
) + """ FROM (SELECT factor, unnest(steps) AS s FROM (VALUES ('Revenue',[-30,-20,-10,10,20]), ('Operating margin',[-8,-4,4,8]),
  ('Debt',[-20,-10,10,20]), ('Interest cost',[-50,50,100]), ('Current liabilities',[-20,20,40]), ('Receivables',[-30,-10,10])) v(factor, steps)))"""
OUT = f"SELECT record_id, scenario, sx AS risk_index, {band4('sx')} AS risk_category, sx-base_index AS change FROM stressed"
LEV = [("revenue_change", "Revenue IS NOT NULL AND EBITDA IS NOT NULL", 6), ("margin_change", "Revenue IS NOT NULL AND EBITDA IS NOT NULL", 5),
       ("debt_change", "Debt IS NOT NULL", 5), ("interest_change", "Interest_Expense IS NOT NULL", 4),
       ("current_liability_change", "Current_Liabilities IS NOT NULL AND Current_Assets IS NOT NULL", 4),
       ("receivable_change", "Accounts_Receivable IS NOT NULL", 4)]
READY = "(Revenue<>0 AND EBITDA IS NOT NULL AND Debt IS NOT NULL)"
WHATIF = f"""shocked AS (SELECT record_id, CASE WHEN {READY} THEN Revenue*(1+(-0.15{D})) ELSE Revenue END AS Revenue,
  CASE WHEN {READY} THEN Revenue*(1+(-0.15{D}))*(EBITDA/nullif(Revenue,0)+(-0.03{D})) ELSE EBITDA END AS EBITDA,
  Net_Profit, Total_Assets*(1+(-0.05{D})) AS Total_Assets, Total_Liabilities*(1+0.05{D}) AS Total_Liabilities,
  Current_Assets, Current_Liabilities, Cash_Flow_Operations*(1+(-0.25{D})) AS Cash_Flow_Operations,
  CASE WHEN {READY} THEN Debt*(1+0.10{D}) ELSE Debt END AS Debt, Interest_Expense*(1+0.30{D}) AS Interest_Expense,
  Accounts_Receivable*(1+0.20{D}) AS Accounts_Receivable, Inventory*(1+0.10{D}) AS Inventory, Cost_of_Goods_Sold,
  (1+Sales_Growth)*(1+(-0.15{D}))-1 AS Growth_In FROM risk)"""
WARN = joined(zip(FLAG_NAMES, ["Growth_In <= -0.15::DOUBLE", "Debt_to_Assets>=0.65::DOUBLE", "Current_Ratio<1",
                               "EBITDA_Margin<0 OR coalesce(Net_Profit_Margin<0,false)", "Cash_Flow_Operations<0",
                               "Receivable_Days>90", "Interest_Coverage<1.5::DOUBLE"]))
SQL = {
    "stress_grid": sql("risk", OUT, f"{GRID}, {adjust('scen')}, {scored('shocked')}"),
    "stress_presets": sql("risk", OUT, f"{PRESETS}, {adjust('scen')}, {scored('shocked')}"),
    "stress_summary": sql("risk", f"""SELECT record_id, count(*) AS scenarios, max(sx) AS worst_index, min(sx) AS best_index,
      (array_agg(scenario ORDER BY sx DESC, no) FILTER (sx IS NOT NULL))[1] AS worst_scenario,
      (array_agg(scenario ORDER BY sx, no) FILTER (sx IS NOT NULL))[1] AS best_scenario,
      round(avg(sx-base_index),6) AS mean_change, count(*) FILTER (sx>=60) AS elevated,
      count(*) FILTER (sx>base_index+1e-9) AS worse_than_reported, {band4('max(sx)')} AS worst_band
      FROM stressed GROUP BY 1""", f"{GRID}, {adjust('scen')}, {scored('shocked')}"),
    "stress_levers": sql("statements", "SELECT record_id, " + ", ".join(f"{c} AS can_{k}" for k, c, _ in LEV) + " FROM statements"),
    "scenario_levels": sql("statements", "SELECT CAST(" + "*".join(f"(CASE WHEN {c} THEN {n} ELSE 1 END)" for _, c, n in LEV)
                           + " AS BIGINT) AS grid_size, count(*) AS records FROM statements GROUP BY 1"),
    "sensitivity": sql("risk", f"""SELECT record_id, factor, dn AS downside_index, up AS upside_index, dn-b AS downside_impact,
      up-b AS upside_impact, {band4('greatest(dn,up)')} AS worst_band, {band4('least(dn,up)')} AS best_band,
      abs(dn-b)+abs(up-b) AS total_impact FROM (SELECT record_id, factor, max(base_index) AS b, max(sx) FILTER (side='d') AS dn,
      max(sx) FILTER (side='u') AS up FROM stressed GROUP BY 1,2)""", f"{ENDS}, {adjust('scen')}, {scored('shocked')}"),
    "breakeven": sql("risk", """SELECT record_id, 'Revenue' AS factor, max(base_index) AS base_index,
      min(step) FILTER (sx<60) AS breakeven_step FROM stressed GROUP BY 1""", f"{STEPS}, {adjust('scen')}, {scored('shocked')}"),
    "breakeven_levers": sql("risk", """SELECT record_id, factor, CASE WHEN step<0 THEN 'downside' ELSE 'upside' END AS side, max(base_index) AS base_index,
      arg_max(step, abs(step)) FILTER (sx<60) AS breakeven_step FROM stressed GROUP BY 1,2,3""", f"{MOVES}, {adjust('scen')}, {scored('shocked')}"),
    "whatif": sql("risk", f"""SELECT record_id, Revenue, EBITDA, Debt, Total_Assets, Growth_In AS Sales_Growth, Current_Ratio,
      sx AS risk_index, CASE WHEN sx IS NULL THEN 'Insufficient Data' WHEN sx/100<0.25{D} THEN 'Low Risk'
      WHEN sx/100<0.6{D} THEN 'Moderate Risk' ELSE 'High Risk' END AS risk_category, 100{D}-sx AS health_score,
      {WARN} AS warnings FROM stressed""", f"{WHATIF}, {scored('shocked')}"),
    "scenario_three": sql("risk", f"""SELECT record_id, CASE WHEN {READY} THEN Revenue*(1+(-0.2{D})) ELSE Revenue END AS Revenue,
      CASE WHEN {READY} THEN Revenue*(1+(-0.2{D}))*(EBITDA/nullif(Revenue,0)+(-0.04{D})) ELSE EBITDA END AS EBITDA,
      CASE WHEN {READY} THEN Debt*(1+0.1{D}) ELSE Debt END AS Debt,
      CASE WHEN {READY} THEN (1+Sales_Growth)*(1+(-0.2{D}))-1 ELSE Sales_Growth END AS Sales_Growth,
      CASE WHEN Revenue IS NULL THEN 'Revenue is missing' WHEN EBITDA IS NULL THEN 'EBITDA is missing'
      WHEN Debt IS NULL THEN 'Debt is missing' WHEN Revenue=0 THEN 'Revenue is zero' END AS reason FROM risk"""),
}
