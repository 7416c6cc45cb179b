from oracles.base import sql

FY = "make_date(year({d})+21,3,31)"


def kind(zero, lakh, crore, neg):
    return f"""CASE o_orderkey%8 WHEN 0 THEN {zero} WHEN 1 THEN {zero} WHEN 2 THEN {zero} WHEN 3 THEN {lakh} WHEN 4 THEN {crore}
      WHEN 5 THEN {neg} END"""


P = "o_totalprice"
TEXT = """CASE o_orderkey%8 WHEN 0 THEN u||'.'||c WHEN 1 THEN g||'.'||c WHEN 2 THEN '₹'||g||'.'||c
  WHEN 3 THEN 'Rs. '||u||'.'||c||' Lakhs' WHEN 4 THEN u||'.'||c||' Crore' WHEN 5 THEN '('||g||'.'||c||')' WHEN 6 THEN 'n/a' ELSE '' END"""
SRC = """(SELECT *, CAST(x//100 AS VARCHAR) AS u, format('{:,}', x//100) AS g, lpad(CAST(x%100 AS VARCHAR),2,'0') AS c
  FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS x FROM orders))"""
LONG = """lg AS (SELECT company_id, make_date(year(period)+21,3,31) AS period, unnest(['Revenue','Short_Term_Debt','Long_Term_Debt','Accounts_Payable',
  'Cash_Balance','Accounts_Receivable','Inventory']) AS metric, unnest([floor(Revenue), floor(Debt*0.25::DOUBLE), floor(Debt*0.75::DOUBLE),
  floor(Current_Liabilities*0.5::DOUBLE), floor(Revenue*0.125::DOUBLE), floor(Accounts_Receivable), floor(Inventory)]) AS value FROM statements),
w AS (SELECT company_id, period, max(value) FILTER (metric='Revenue') AS rev, max(value) FILTER (metric='Short_Term_Debt') AS st,
  max(value) FILTER (metric='Long_Term_Debt') AS lt, max(value) FILTER (metric='Accounts_Payable') AS ap, max(value) FILTER (metric='Cash_Balance') AS cash,
  max(value) FILTER (metric='Accounts_Receivable') AS ar, max(value) FILTER (metric='Inventory') AS inv FROM lg GROUP BY 1,2)"""


def plus(*parts):
    return ("CASE WHEN coalesce(" + ",".join(parts) + ") IS NOT NULL THEN 0::DOUBLE+" + "+".join(f"coalesce({p},0)" for p in parts) + " END")


def first(c):
    return f"arg_min({c}, o_orderkey) FILTER ({c} IS NOT NULL)"


SQL = {
    "text_keys": """SELECT o_orderkey, 'sales & tax (rs.) [net] '||replace(lower(o_orderpriority),'-',' ')||' '||lower(o_orderstatus) AS spaced,
      'sales tax rs net '||replace(lower(o_orderpriority),'-',' ')||' '||lower(o_orderstatus) AS alnum,
      'sales and tax '||replace(lower(o_orderpriority),'-',' ')||' '||lower(o_orderstatus) AS label FROM orders""",
    "parse_amount": f"SELECT o_orderkey, {TEXT} AS amount_text, {kind(P, P+'*100000', P+'*10000000', '-'+P)} AS amount FROM {SRC}",
    "parse_scaled_amount": f"SELECT o_orderkey, {kind(P+'*1000', P+'*100000', P+'*10000000', '-'+P+'*1000')} AS amount FROM orders",
    "unit_scale": "SELECT o_orderkey, CASE o_orderkey%8 WHEN 3 THEN 100000 WHEN 4 THEN 10000000 ELSE 1 END::DOUBLE AS scale FROM orders",
    "parse_period": """SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN y::VARCHAR WHEN 1 THEN 'FY '||y||'-'||lpad(CAST((y+1)%100 AS VARCHAR),2,'0')
      WHEN 2 THEN y||strftime(o_orderdate,'-%m-%d') WHEN 3 THEN y||'/'||(y+2) WHEN 4 THEN y||strftime(o_orderdate,'-%m') ELSE 'not stated' END AS period_text,
      CASE o_orderkey%6 WHEN 0 THEN make_date(y,12,31) WHEN 1 THEN make_date(y+1,3,31) WHEN 2 THEN make_date(y,month(o_orderdate),day(o_orderdate))
      WHEN 3 THEN make_date(y+2,12,31) WHEN 4 THEN last_day(make_date(y,month(o_orderdate),1)) END AS period
      FROM (SELECT *, year(o_orderdate)+20 AS y FROM orders)""",
    "normalize_headers": sql("statements", """SELECT company_id, period, Revenue, Net_Profit, Total_Assets, Cash_Flow_Operations, Debt
      FROM statements"""),
    "normalize_tabular": f"""SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS customer_id, 'FY '||(year(o_orderdate)+20)||'-'||
      lpad(CAST((year(o_orderdate)+21)%100 AS VARCHAR),2,'0') AS period,
      coalesce({kind(P+'*100000', P+'*100000', P+'*10000000', '-'+P+'*100000')}, o_totalprice) AS Revenue,
      floor(o_totalprice/1000)*100000 AS loan_amount, o_orderstatus AS loan_status FROM orders""",
    "ingest_tabular": f"""SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_custkey AS VARCHAR) AS company_id,
      {FY.format(d='o_orderdate')} AS period,
      coalesce({kind(P+'*100000', P+'*100000', P+'*10000000', '-'+P+'*100000')}, o_totalprice) AS Revenue,
      floor(o_totalprice/1000)*100000 AS loan_amount, o_orderstatus AS loan_status FROM orders""",
    "collapse_periods": f"""SELECT 'Customer '||o_custkey AS company_id, {FY.format(d='o_orderdate')} AS period, {first('a')} AS Revenue,
      {first('b')} AS Debt, {first('c')} AS Current_Assets FROM (SELECT *, CASE WHEN o_orderkey%3=0 THEN floor(o_totalprice)*1000 END AS a,
      CASE WHEN o_orderkey%3=1 THEN floor(o_totalprice) END AS b, CASE WHEN o_orderkey%3=2 THEN floor(o_totalprice) END AS c FROM orders)
      GROUP BY 1,2""",
    "header_row": sql("statements", """SELECT company_id AS table_id, 1 AS header_row, 5 AS score, 'wide' AS layout FROM statements GROUP BY 1
      UNION ALL SELECT company_id, 0, 2, 'long' FROM statements GROUP BY 1"""),
    "layout_kind": sql("statements", """SELECT true AS items_by_year, false AS loan_table, count(DISTINCT company_id)*5 AS n_rows
      FROM statements"""),
    "wide_records": sql("statements", f"""SELECT company_id AS table_id, 'Customer '||company_id AS company_id, {FY.format(d='period')} AS period,
      floor(Revenue)*1000 AS Revenue, floor(Net_Profit)*100000 AS Net_Profit, floor(Total_Assets)*1000 AS Total_Assets FROM statements"""),
    "transposed_statement": sql("statements", f"""SELECT company_id, {FY.format(d='period')} AS period, floor(Revenue)*1000 AS Revenue,
      floor(Net_Profit)*1000 AS Net_Profit, floor(Accounts_Receivable)*1000 AS Accounts_Receivable, floor(Inventory)*1000 AS Inventory,
      floor(Total_Assets)*1000 AS Total_Assets FROM statements"""),
    "long_statement": sql("statements", "SELECT * FROM lg", LONG),
    "merge_records": sql("statements", f"""SELECT company_id, period, rev AS Revenue, {plus('st','lt')} AS Debt, {plus('cash','ar','inv')} AS Current_Assets,
      {plus('ap','st')} AS Current_Liabilities, ar AS Accounts_Receivable, inv AS Inventory FROM w""", LONG),
    "text_statement_records": sql("statements", f"""SELECT record_id, 'Customer '||company_id AS company_id, {FY.format(d='period')} AS period, metric, value
      FROM (SELECT *, unnest(['Revenue','Net_Profit','Total_Assets']) AS metric,
      unnest([floor(Revenue)*1000, floor(Net_Profit)*1000, floor(Total_Assets)*100000]) AS value FROM statements) WHERE value IS NOT NULL"""),
    "document_company": sql("statements", """SELECT 's'||record_id AS document, 'Customer '||company_id AS company FROM statements
      UNION ALL SELECT 'd'||doc_id, CASE WHEN m<>'' THEN trim(m, chr(9)||chr(13)||' |') ELSE replace(replace(source,'_',' '),'-',' ') END FROM (
      SELECT *, regexp_extract(text, '(?im)^\\s*(?:company\\s*name|entity\\s*name|business\\s*name|company|entity)\\s*[:\\-]\\s*(.{2,100})$', 1) AS m
      FROM documents)"""),
    "text_lines": """SELECT doc_id, CAST(i-1 AS INT) AS line_no, line FROM (SELECT doc_id, generate_subscripts(l,1) AS i,
      trim(regexp_replace(unnest(l),'\\s+',' ','g')) AS line FROM (SELECT doc_id, regexp_split_to_array(text,'\\r\\n|\\r|\\n') AS l FROM documents))
      WHERE line<>''""",
    "read_delimited": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer",
    "read_quoted": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name||chr(10)||c_mktsegment||', "'||c_nationkey||'"'||chr(10) AS note,
      CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer""",
    "read_grid": "SELECT s_suppkey||'/'||s_name||chr(10)||'|'||s_nationkey||'/'||s_nationkey AS line, true AS in_order FROM supplier",
    "file_statements": sql("statements", f"""SELECT 'Customer '||company_id AS company_id, {FY.format(d='period')} AS period,
      floor(Revenue)*1000 AS Revenue, floor(Net_Profit)*100000 AS Net_Profit, floor(Total_Assets)*1000 AS Total_Assets FROM statements"""),
    "sink_roundtrip": sql("loans", "SELECT loan_id, loan_amount, loan_status, country FROM loans"),
    "stack_tables": """SELECT c_name AS party, c_acctbal AS balance, c_mktsegment AS segment, NULL::INT AS nation FROM customer
      UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier""",
}
