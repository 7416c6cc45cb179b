"""Shared common table expressions, written independently of the Spark expressions."""

from __future__ import annotations

CORE = ("Revenue EBITDA Net_Profit Total_Assets Total_Liabilities Current_Assets Current_Liabilities "
        "Cash_Flow_Operations Debt Interest_Expense Accounts_Receivable Inventory Cost_of_Goods_Sold").split()
RATIOS = ("Current_Ratio Quick_Ratio Debt_to_Equity Debt_to_Assets Interest_Coverage ROA ROE EBITDA_Margin "
          "Net_Profit_Margin Operating_Cash_Flow_Ratio Receivable_Days Inventory_Days").split()


def ratio(n, d):
    return (f"CASE WHEN abs({d}) > 1e-9 AND ({n}) IS NOT NULL "
            f"THEN least(greatest(({n})/({d}), -100::DOUBLE), 100::DOUBLE) END")


def days(n):
    return (f"CASE WHEN abs(Revenue) > 1e-9 AND {n} IS NOT NULL "
            f"THEN least(greatest({n}/Revenue*365, 0::DOUBLE), 3650::DOUBLE) END")


def present(names):
    return " + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n in names)


CTES = {
    "statements": ("", """
statements_raw AS (
  SELECT o.o_custkey AS k, year(o.o_orderdate) AS y, any_value(c.c_acctbal) AS bal,
    SUM(n)/10000::DOUBLE AS revenue, SUM(n)/10000::DOUBLE - SUM(cost)/10000::DOUBLE AS ebitda,
    SUM(CASE WHEN o.o_orderstatus='F' THEN n ELSE 0 END)/10000::DOUBLE*0.55::DOUBLE AS fd,
    SUM(CASE WHEN l_linestatus='O' THEN n ELSE 0 END)/10000::DOUBLE*0.35::DOUBLE AS ar,
    SUM(CASE WHEN l_returnflag='R' THEN n ELSE 0 END)/10000::DOUBLE*0.35::DOUBLE AS inv,
    SUM(CASE WHEN l_returnflag='N' THEN n ELSE 0 END)/10000::DOUBLE*0.75::DOUBLE AS cl,
    SUM(goods)/10000::DOUBLE AS cogs
  FROM (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT)*(100-CAST(round(l_discount*100) AS BIGINT)) AS n,
               CAST(round(l_extendedprice*100) AS BIGINT)*(78+3*CAST(round(l_tax*100) AS BIGINT)) AS cost,
               CAST(round(l_extendedprice*100) AS BIGINT)*(60+2*CAST(round(l_tax*100) AS BIGINT)) AS goods
        FROM lineitem) l JOIN orders o ON l.l_orderkey=o.o_orderkey
       JOIN customer c ON c.c_custkey=o.o_custkey
  GROUP BY 1, 2),
statements AS (
  SELECT k*10000+y AS record_id, CAST(k AS VARCHAR) AS company_id, make_date(y,12,31) AS period,
    revenue AS Revenue,
    CASE WHEN k%97<>0 THEN ebitda END AS EBITDA,
    CASE WHEN k%97<>0 THEN ebitda-revenue*0.06::DOUBLE-fd*0.08::DOUBLE END AS Net_Profit,
    CASE WHEN k%97<>0 THEN revenue*0.45::DOUBLE+ar+inv END AS Total_Assets,
    CASE WHEN k%97<>0 THEN cl+fd*0.8::DOUBLE END AS Total_Liabilities,
    CASE WHEN k%97<>0 THEN ar+inv+greatest(bal,0::DOUBLE) END AS Current_Assets,
    CASE WHEN k%97<>0 THEN cl END AS Current_Liabilities,
    CASE WHEN k%97<>0 THEN ebitda-ar*0.25::DOUBLE END AS Cash_Flow_Operations,
    CASE WHEN k%97<>0 AND k%11<>0 THEN fd END AS Debt,
    CASE WHEN k%97<>0 AND k%7<>0 THEN fd*0.08::DOUBLE END AS Interest_Expense,
    CASE WHEN k%97<>0 THEN ar END AS Accounts_Receivable,
    CASE WHEN k%97<>0 THEN inv END AS Inventory,
    CASE WHEN k%97<>0 THEN cogs END AS Cost_of_Goods_Sold,
    NULL::DOUBLE AS Sales_Growth
  FROM statements_raw)"""),
    "features": ("statements", f"""
ratio_rows AS (SELECT * EXCLUDE (Sales_Growth),
  {ratio('Current_Assets','Current_Liabilities')} AS Current_Ratio,
  {ratio('Current_Assets-Inventory','Current_Liabilities')} AS Quick_Ratio,
  {ratio('Debt','(Total_Assets-Total_Liabilities)')} AS Debt_to_Equity,
  {ratio('Debt','Total_Assets')} AS Debt_to_Assets,
  {ratio('EBITDA','Interest_Expense')} AS Interest_Coverage,
  {ratio('Net_Profit','Total_Assets')} AS ROA,
  {ratio('Net_Profit','(Total_Assets-Total_Liabilities)')} AS ROE,
  {ratio('EBITDA','Revenue')} AS EBITDA_Margin,
  {ratio('Net_Profit','Revenue')} AS Net_Profit_Margin,
  {ratio('Cash_Flow_Operations','Current_Liabilities')} AS Operating_Cash_Flow_Ratio,
  {days('Accounts_Receivable')} AS Receivable_Days,
  {days('Inventory')} AS Inventory_Days FROM statements),
lagged AS (SELECT *, lag(period) OVER h AS p_period, lag(Revenue) OVER h AS p_rev,
    lag(Debt_to_Assets) OVER h AS p_da, lag(Current_Ratio) OVER h AS p_cr, lag(EBITDA_Margin) OVER h AS p_em,
    lag(Receivable_Days) OVER h AS p_rd, lag(Interest_Coverage) OVER h AS p_ic
  FROM ratio_rows WINDOW h AS (PARTITION BY company_id ORDER BY period NULLS LAST, record_id)),
grown AS (SELECT *, CASE WHEN p_rev<>0 THEN Revenue/p_rev-1 WHEN p_rev=0 AND Revenue>0 THEN 10::DOUBLE
    WHEN p_rev=0 AND Revenue<0 THEN -10::DOUBLE END AS g FROM lagged),
features AS (SELECT * EXCLUDE (g), CASE WHEN g IS NOT NULL THEN least(greatest(g,-10::DOUBLE),10::DOUBLE) END
    AS Sales_Growth FROM grown)"""),
    "flags": ("features", """
flags AS (SELECT *,
  coalesce(Sales_Growth <= -0.15::DOUBLE, false) AS f1,
  coalesce(Debt_to_Assets >= 0.65::DOUBLE, false) OR coalesce(Debt_to_Assets > p_da+0.05::DOUBLE, false) AS f2,
  coalesce(Current_Ratio < 1, false) OR coalesce(Current_Ratio < p_cr*0.9::DOUBLE, false) AS f3,
  coalesce(EBITDA_Margin < 0, false) OR coalesce(Net_Profit_Margin < 0, false)
    OR coalesce(EBITDA_Margin < p_em, false) AS f4,
  coalesce(Cash_Flow_Operations < 0, false) AS f5,
  coalesce(Receivable_Days > 90, false) OR coalesce(Receivable_Days > p_rd+10, false) AS f6,
  coalesce(Interest_Coverage < 1.5::DOUBLE, false) OR coalesce(Interest_Coverage < p_ic, false) AS f7
  FROM features)"""),
    "risk": ("flags", f"""
risk_in AS (SELECT *, coalesce(Debt_to_Equity,
    CASE WHEN abs(coalesce(Total_Assets-Total_Liabilities, Total_Assets-Debt)) > 1e-9
    THEN Debt/coalesce(Total_Assets-Total_Liabilities, Total_Assets-Debt) END) AS de,
    {present(CORE)} AS n_obs FROM flags),
risk_pts AS (SELECT *,
  0::DOUBLE + CASE WHEN de<0 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN de>2 THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN Current_Ratio<1 THEN 0.22::DOUBLE WHEN Current_Ratio<1.2::DOUBLE THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN Debt_to_Assets>=0.65::DOUBLE THEN 0.18::DOUBLE ELSE 0 END
  + CASE WHEN Net_Profit_Margin<0 THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN ROA<0 THEN 0.10::DOUBLE ELSE 0 END
  + CASE WHEN Interest_Coverage<1.5::DOUBLE THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN Sales_Growth < -0.15::DOUBLE THEN 0.12::DOUBLE ELSE 0 END
  + CASE WHEN Cash_Flow_Operations<0 THEN 0.15::DOUBLE ELSE 0 END AS pts,
  CAST(coalesce(Current_Ratio>=1.5::DOUBLE,false) AS INT)+CAST(coalesce(de>=0 AND de<=2,false) AS INT)
  +CAST(coalesce(Net_Profit_Margin>=0,false) AS INT)+CAST(coalesce(ROA>=0,false) AS INT)
  +CAST(coalesce(Interest_Coverage>=1.5::DOUBLE,false) AS INT)+CAST(coalesce(Sales_Growth>0,false) AS INT)
  +CAST(coalesce(Cash_Flow_Operations>0,false) AS INT) AS prot FROM risk_in),
risk_ix AS (SELECT *, CASE WHEN n_obs>=2 THEN
    least(greatest(pts-least(0.20::DOUBLE, prot*0.04::DOUBLE),0::DOUBLE),1::DOUBLE)*100 END AS ix FROM risk_pts),
risk AS (SELECT *, CASE WHEN ix IS NULL THEN 'Insufficient Data' WHEN ix/100<0.25::DOUBLE THEN 'Low Risk'
    WHEN ix/100<0.60::DOUBLE THEN 'Moderate Risk' ELSE 'High Risk' END AS band,
    CASE WHEN ix IS NOT NULL THEN least(greatest(100::DOUBLE-ix,0::DOUBLE),100::DOUBLE) END AS health,
    CAST(f1 AS BIGINT)+CAST(f2 AS BIGINT)+CAST(f3 AS BIGINT)+CAST(f4 AS BIGINT)+CAST(f5 AS BIGINT)
    +CAST(f6 AS BIGINT)+CAST(f7 AS BIGINT) AS n_flags FROM risk_ix)"""),
    "loans": ("", """
loans AS (SELECT o_orderkey AS loan_id, o_custkey AS customer_id, o_totalprice AS loan_amount,
    o_orderdate AS origination_date,
    CASE o_orderstatus WHEN 'F' THEN 'Default' WHEN 'O' THEN 'Current' WHEN 'P' THEN 'Fully Paid' END AS loan_status,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
      WHEN '5-LOW' THEN 'Low' END AS risk_status,
    CAST(floor(300+(c_acctbal+1000)/11000*600) AS BIGINT) AS credit_score, c_mktsegment AS segment,
    n_name AS country, r_name AS region
  FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey
  JOIN region ON r_regionkey=n_regionkey)"""),
    "pairs": ("loans", """
pairs AS (SELECT loan_id, customer_id, segment,
    least(greatest((900-credit_score)/600::DOUBLE, 0::DOUBLE),1::DOUBLE) AS p,
    CASE WHEN loan_status='Default' THEN 1 ELSE 0 END AS label FROM loans)"""),
}


def sql(needs: str, body: str, extra: str = "") -> str:
    """``WITH`` the named expressions (and what they need), then ``body``."""
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0].split():
            visit(dep)
        if name not in done:
            done.append(name)

    for name in needs.split():
        visit(name)
    parts = [CTES[name][1].strip() for name in done]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def joined(pairs) -> str:
    """Comma-joined names of the conditions that hold."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs)
    return f"concat_ws(', ', {items})"
