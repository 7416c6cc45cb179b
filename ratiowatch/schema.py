"""Canonical column names and the header vocabulary.

The word lists below are fixed values: an upload is only recognised if these
spellings map to these canonical names.
"""

from __future__ import annotations

FINANCIAL_COLUMNS = (
    "Revenue", "EBITDA", "Net_Profit", "Total_Assets", "Total_Liabilities",
    "Current_Assets", "Current_Liabilities", "Cash_Flow_Operations", "Debt",
    "Interest_Expense", "Accounts_Receivable", "Inventory", "Cost_of_Goods_Sold",
    "Sales_Growth",
)
CORE_FIELDS = FINANCIAL_COLUMNS[:-1]
COMPONENT_COLUMNS = (
    "Cash_Balance", "Accounts_Payable", "Short_Term_Debt", "Long_Term_Debt", "Equity_Value",
)
MODEL_CORE_FIELDS = (
    "Revenue", "EBITDA", "Net_Profit", "Total_Assets", "Total_Liabilities",
    "Current_Assets", "Current_Liabilities", "Cash_Flow_Operations", "Debt",
)
RATIO_COLUMNS = (
    "Current_Ratio", "Quick_Ratio", "Debt_to_Equity", "Debt_to_Assets",
    "Interest_Coverage", "ROA", "ROE", "EBITDA_Margin", "Net_Profit_Margin",
    "Operating_Cash_Flow_Ratio", "Receivable_Days", "Inventory_Days",
)
MODEL_FEATURES = FINANCIAL_COLUMNS + RATIO_COLUMNS
MONITORED_FEATURES = (
    "Revenue", "Net_Profit", "Total_Assets", "Current_Liabilities", "Debt",
    "Cash_Flow_Operations", "Current_Ratio", "Debt_to_Assets", "EBITDA_Margin",
    "Interest_Coverage",
)

# Header spellings by canonical measure, shared by both readers.
MEASURE_SPELLINGS = {
    "Revenue": ("sales", "net sales", "turnover", "gross revenue", "gross sales",
                "total income", "income from operations"),
    "EBITDA": ("ebitda", "operating profit", "operating profit before depreciation"),
    "Net_Profit": ("net profit", "profit after tax", "pat", "net income", "profit for the year",
                   "profit after taxation", "net profit after tax"),
    "Total_Assets": ("total assets", "assets"),
    "Total_Liabilities": ("total liabilities", "liabilities"),
    "Current_Assets": ("current assets", "total current assets"),
    "Current_Liabilities": ("current liabilities", "total current liabilities"),
    "Cash_Flow_Operations": ("operating cash flow", "cash flow from operations",
                             "cash flow from operating activities", "cash generated from operations",
                             "net cash from operating activities"),
    "Debt": ("total debt", "debt", "borrowings", "total borrowings", "total loans", "loans"),
    "Interest_Expense": ("interest expense", "finance costs", "finance cost"),
    "Accounts_Receivable": ("accounts receivable", "trade receivables", "receivables", "debtors"),
    "Inventory": ("inventory", "inventories", "stock"),
    "Cost_of_Goods_Sold": ("cost of goods sold", "cost of sales", "cogs"),
    "Sales_Growth": ("sales growth", "revenue growth"),
}
# Spellings only the plain statement table accepts.
STATEMENT_ONLY_SPELLINGS = {
    "Revenue": ("annual revenue", "total revenue", "operating revenue", "total sales", "annual sales"),
    "Net_Profit": ("profit", "earnings"),
    "EBITDA": ("operating ebitda",),
    "Total_Assets": ("asset",),
    "Cash_Flow_Operations": ("cfo", "cashflow", "operating cash"),
    "Interest_Expense": ("interest",),
    "Accounts_Receivable": ("receivable",),
    "Debt": ("loan balance", "outstanding", "exposure"),
    "Sales_Growth": ("growth",),
    "distress_label": ("distress", "default", "default label", "distress label"),
    "period": ("date", "year", "financial year", "period", "month"),
}
# Spellings only documents and general tables accept.
DOCUMENT_ONLY_SPELLINGS = {
    "Revenue": ("revenue",),
    "Cash_Flow_Operations": ("cash flow operations",),
    "Cash_Balance": ("cash and cash equivalents", "cash equivalents", "cash and bank balances",
                     "cash and bank", "cash balance"),
    "Accounts_Payable": ("trade payables", "accounts payable", "payables"),
    "Short_Term_Debt": ("short term borrowings", "short term debt", "current portion of long term debt"),
    "Long_Term_Debt": ("long term borrowings", "long term debt"),
    "Equity_Value": ("shareholders equity", "shareholder equity", "owners equity", "net worth"),
}
# Identity and credit headers of customer and loan tables.
CREDIT_SPELLINGS = {
    "company_id": ("company", "company id", "company name", "entity", "entity name", "business name"),
    "customer_id": ("customer id", "customerid", "customer identifier", "client id", "borrower id",
                    "borrowerid", "borrower identifier", "account id", "customer number",
                    "borrower number", "member id"),
    "loan_id": ("loan id", "loanid"),
    "customer_name": ("customer name", "borrower name", "client name", "name"),
    "credit_score": ("credit score", "cibil score", "bureau score"),
    "loan_amount": ("loan amount", "sanctioned amount", "principal amount", "outstanding amount",
                    "loan balance"),
    "default_status": ("default status", "defaulted", "is default", "is defaulted", "default flag",
                       "default label", "delinquent", "bad loan", "default"),
    "loan_status": ("loan status", "repayment status", "payment status", "application status"),
    "risk_status": ("risk status", "risk category", "risk level", "credit risk"),
    "period": ("period", "year", "financial year", "fiscal year", "date", "reporting period",
               "month", "quarter"),
    "Revenue": ("income", "annual income", "yearly income", "monthly income", "salary",
                "annual salary", "annual revenue", "total sales", "annual sales"),
    "Net_Profit": ("profit", "earnings"),
}
CREDIT_COLUMNS = ("credit_score", "loan_amount", "default_status", "loan_status", "risk_status")
PERIOD_HEADERS = ("period", "year", "financial year", "fiscal year", "date", "reporting period")
ITEM_HEADERS = ("particulars", "particular", "financial item", "line item", "description",
                "metric", "account", "indicator", "item")
COMPANY_HEADERS = CREDIT_SPELLINGS["company_id"]
VALUE_HEADERS = ("value", "amount", "balance", "reported value", "inr", "rs", "rupees")


def spelling_map(*tables: dict) -> dict:
    """Flatten ``canonical -> spellings`` tables into ``spelling -> canonical``; first wins."""
    flat: dict[str, str] = {}
    for table in tables:
        for canonical, spellings in table.items():
            for spelling in spellings:
                flat.setdefault(spelling, canonical)
    return flat


STATEMENT_HEADERS = {
    **{name.replace("_", " ").lower(): name for name in FINANCIAL_COLUMNS},
    **spelling_map(MEASURE_SPELLINGS, STATEMENT_ONLY_SPELLINGS),
}
METRIC_LABELS = spelling_map(MEASURE_SPELLINGS, DOCUMENT_ONLY_SPELLINGS)
TABLE_HEADERS = {**spelling_map(CREDIT_SPELLINGS), **METRIC_LABELS}
