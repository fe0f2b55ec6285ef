"""ledgerlens: customer-transaction analytics as Spark DataFrame operators.

Every public operator takes a ``customer_transactions`` DataFrame (see
``ledgerlens.schema.CT_SCHEMA``) and returns a lazy DataFrame. Nothing is
collected to the driver; planning and execution are left to Catalyst.
"""

from ledgerlens.schema import CT_SCHEMA, CT_COLUMNS
from ledgerlens.operators.customers import (
    top_loyal_customers,
    customer_summary,
    classify_payers,
    filter_customers,
    sort_customers,
)
from ledgerlens.operators.discounts import (
    discounts_by_gender,
    discounts_by_age_group,
    sales_by_discount,
)
from ledgerlens.operators.cashflow import (
    historical_cash_flow,
    estimate_cash_flow,
    cash_flow_trend,
)
from ledgerlens.operators.geo import (
    age_group_sales_by_state,
    product_counts_by_state,
    sales_by_state,
    state_heatmap,
    heatmap_legend,
)
from ledgerlens.operators.charts import chart_series
from ledgerlens.operators.quality import key_violations

__all__ = [
    "CT_SCHEMA",
    "CT_COLUMNS",
    "top_loyal_customers",
    "customer_summary",
    "classify_payers",
    "filter_customers",
    "sort_customers",
    "discounts_by_gender",
    "discounts_by_age_group",
    "sales_by_discount",
    "historical_cash_flow",
    "estimate_cash_flow",
    "cash_flow_trend",
    "age_group_sales_by_state",
    "product_counts_by_state",
    "sales_by_state",
    "state_heatmap",
    "heatmap_legend",
    "chart_series",
    "key_violations",
]
