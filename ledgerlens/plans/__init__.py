"""Composed plans: the reference's page flows as single DataFrame chains."""

from ledgerlens.plans.dashboard import (
    age_group_revenue_chart,
    customer_table,
    discount_breakdowns,
    discount_type_chart,
    gender_revenue_chart,
    loyalty_chart,
    map_breakdowns,
    sales_heatmap,
    state_age_chart,
    state_product_chart,
)
from ledgerlens.plans.ordered import (
    age_group_sales_positions,
    cash_flow_trend_positions,
    customer_summary_positions,
    historical_cash_flow_positions,
    product_counts_positions,
    sales_by_discount_positions,
    sales_by_state_positions,
    sort_customers_positions,
    top_loyal_positions,
)

__all__ = [
    "age_group_sales_positions",
    "cash_flow_trend_positions",
    "customer_summary_positions",
    "historical_cash_flow_positions",
    "product_counts_positions",
    "sales_by_discount_positions",
    "sales_by_state_positions",
    "sort_customers_positions",
    "top_loyal_positions",
    "age_group_revenue_chart",
    "customer_table",
    "discount_breakdowns",
    "discount_type_chart",
    "gender_revenue_chart",
    "loyalty_chart",
    "map_breakdowns",
    "sales_heatmap",
    "state_age_chart",
    "state_product_chart",
]
