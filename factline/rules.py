"""Rule tables that results depend on.  All of them are fixed values."""

from __future__ import annotations

# Government levels in display order; ``national`` folds into ``federal``.
LEVEL_ORDER = ("federal", "state", "territory", "local")
LEVEL_LABELS = {"federal": "Federal", "state": "State", "territory": "Territory", "local": "Local"}

# What each view family accepts.
NEUTRAL_PRICE_BASES = ("unspecified", "not_applicable")
EXPENSE_PRICE_BASES = ("not_applicable", "unspecified", "current_prices")
VIEW_FAMILIES = {
    "actual_expense": {"units": ("AUD",), "price_bases": EXPENSE_PRICE_BASES},
    "budget_expense": {"units": ("AUD",), "price_bases": EXPENSE_PRICE_BASES},
    "gfs_revenue": {"units": ("AUD",), "price_bases": EXPENSE_PRICE_BASES},
    "debt_stock": {
        "units": ("AUD",),
        "price_bases": ("not_applicable", "unspecified"),
        "one_valuation_for_total": True,
        "mix_dates": False,
    },
    "gdp_current": {"units": ("AUD",), "price_bases": ("current_prices",), "measures": ("gdp_current",)},
    "gdp_chain_volume": {"units": ("AUD",), "price_bases": ("chain_volume",), "measures": ("gdp_chain_volume",)},
    "gdp_expenditure": {"units": ("AUD",), "price_bases": ("current_prices",), "measures": ("gdp_current",)},
    "gva_current": {"units": ("AUD",), "price_bases": ("current_prices",), "measures": ("gdp_current", "gva_current")},
    "gva_chain_volume": {
        "units": ("AUD",),
        "price_bases": ("chain_volume",),
        "measures": ("gdp_chain_volume", "gva_chain_volume"),
    },
    "gsp_current": {"units": ("AUD",), "price_bases": ("current_prices",), "measures": ("gsp_current",)},
    "gsp_chain_volume": {"units": ("AUD",), "price_bases": ("chain_volume",), "measures": ("gsp_chain_volume",)},
    "ratios": {
        "units": ("percent",),
        "price_bases": ("not_applicable",),
        "measures": ("tax_to_gdp_ratio",),
        "additive": False,
        "root_total": False,
    },
}

# Dashboard mode -> (group, statuses, family, economy filter).
ACTUAL = ("actual", "audited_actual")
FORWARD = ("budget", "forward_estimate", "revised_estimate", "estimated_actual")
MODES = {
    "actuals": ("actual_expense", ACTUAL, "actual_expense", None),
    "budget": ("budget_expense", FORWARD, "budget_expense", None),
    "debt": ("gfs_liability", ACTUAL, "debt_stock", None),
    "revenue": ("gfs_revenue", ACTUAL, "gfs_revenue", None),
    "gdp": ("gdp", ACTUAL, "gdp_current", "gdp_current"),
    "gdp_current": ("gdp", ACTUAL, "gdp_current", "gdp_current"),
    "gdp_chain_volume": ("gdp", ACTUAL, "gdp_chain_volume", "gdp_chain_volume"),
    "gdp_expenditure": ("gdp", ACTUAL, "gdp_expenditure", "gdp_expenditure"),
    "gva_current": ("gdp", ACTUAL, "gva_current", "gva_current"),
    "gva_chain_volume": ("gdp", ACTUAL, "gva_chain_volume", "gva_chain_volume"),
    "gsp_current": ("gdp", ACTUAL, "gsp_current", "gsp_current"),
    "gsp_chain_volume": ("gdp", ACTUAL, "gsp_chain_volume", "gsp_chain_volume"),
    "ratios": ("gdp", ACTUAL, "ratios", "ratios"),
}
ECONOMY_MEASURES = {
    "gdp_current": ("gdp_current",),
    "gdp_chain_volume": ("gdp_chain_volume",),
    "gdp_expenditure": ("gdp_current",),
    "gva_current": ("gdp_current", "gva_current"),
    "gva_chain_volume": ("gdp_chain_volume", "gva_chain_volume"),
    "gsp_current": ("gsp_current",),
    "gsp_chain_volume": ("gsp_chain_volume",),
    "ratios": ("tax_to_gdp_ratio",),
}

# Patterns of the economy filters.
INDUSTRY_SUFFIX = r"\([A-S]\)\s*($|/)"
RATIO_NAMES = r"(?i)tax.*%|% of gdp|derived ratio"
EXPENDITURE_NAMES = (
    r"(?i)expenditure on gdp|gdp \(current|final consumption|gross fixed|changes in inventories|"
    r"exports of goods|imports of goods|less imports"
)
INDUSTRY_NAMES = r"(?i)\bgva\b|gross value added|industry"

# Liability granularities that mark a published aggregate.
AGGREGATE_GRANULARITIES = ("instrument_type_aggregate", "scheme_aggregate", "council_aggregate")
ROLL_UP_TAG = "roll_up:sum_instruments"

# Purpose labels nested under a larger purpose, and the totals that stand for one.
PURPOSE_PARENT = {
    "Public debt transactions": "General public services",
    "Other general public services": "General public services",
    "Medical products, appliances and equipment": "Health",
    "Outpatient services": "Health",
    "Hospital services": "Health",
    "Community health services": "Health",
    "Public health services": "Health",
    "Other health": "Health",
    "Pre-primary, primary and secondary education": "Education",
    "Tertiary education": "Education",
    "Other education": "Education",
}
PURPOSE_TOTAL = {
    "Total general public services": "General public services",
    "Total health": "Health",
    "Total education": "Education",
}
PURPOSE_SKIP = ("Total Expenses", "Total expenses")
LIABILITY_SKIP = ("Total Liabilities", "Total liabilities")
REVENUE_SKIP = ("Total GFS revenue", "Total gfs revenue")

# Names of the folders that only help navigation.
NAVIGATION_FOLDERS = ("Statement 6", "FBO Appendix A")

# Stock and flow kinds that never share a comparison.
STOCK_KINDS = ("stock", "stock_balance")
FLOW_KINDS = ("flow", "balance")

# Edition order of estimate statuses and groups when one fact stands for a node.
GROUP_RANK = {"budget_expense": 0, "actual_expense": 1}
STATUS_RANK = {"budget": 0, "estimated_actual": 1, "revised_estimate": 2, "forward_estimate": 3, "actual": 4}
