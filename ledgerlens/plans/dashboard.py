"""The reference's request flows as single lazy plans.

Each page of the reference issues several requests and finishes the
work in the browser; here each flow is one DataFrame chain, so the
filters, classification and sort run on the executors and Catalyst sees
the whole plan (predicates pushed, columns pruned, exchanges reused).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.charts import chart_series
from ledgerlens.functions.columns import money_sum, money_total
from ledgerlens.operators.customers import (
    classify_payers,
    customer_summary,
    filter_customers,
    sort_customers,
    top_loyal_customers,
)
from ledgerlens.operators.discounts import (
    discount_metrics,
    discounts_by_age_group,
    discounts_by_gender,
    sales_by_discount,
)
from ledgerlens.operators.geo import (
    age_group_sales_by_state,
    product_counts_by_state,
    sales_by_state,
    state_heatmap,
)


def customer_table(
    ct: DataFrame,
    threshold_days=15,
    age_group: str | None = "",
    gender: str | None = "",
    sort_by: str = "client_name",
    ascending: bool = True,
) -> DataFrame:
    """Customer table page: summary -> payer class -> filters -> sort.

    The demographic filters land on the profile columns above the one shared
    aggregate, before the join with the totals and the final sort.
    """
    summary = classify_payers(customer_summary(ct), threshold_days)
    return sort_customers(filter_customers(summary, age_group, gender), sort_by, ascending)


def loyalty_chart(ct: DataFrame, k: int = 10, criteria: str = "total_spent") -> DataFrame:
    """Loyalty bar chart: top-k names with their score as the value."""
    return chart_series(top_loyal_customers(ct, k, criteria), "client_name", "loyalty_score")


def gender_revenue_chart(ct: DataFrame) -> DataFrame:
    """Polar chart of revenue per gender (the page plots ``total_revenue``)."""
    return chart_series(discounts_by_gender(ct), "gender", "total_revenue")


def age_group_revenue_chart(ct: DataFrame) -> DataFrame:
    """Polar chart of revenue per age group."""
    return chart_series(discounts_by_age_group(ct), "age_group", "total_revenue")


def discount_type_chart(ct: DataFrame) -> DataFrame:
    """Polar chart of revenue per discount type (discounted rows only)."""
    return chart_series(sales_by_discount(ct), "discount_name", "total_revenue")


def state_age_chart(ct: DataFrame, state: str) -> DataFrame:
    """Bar chart shown when hovering a state: sales per age group there."""
    return chart_series(age_group_sales_by_state(ct, state), "age_group", "total_sales")


def state_product_chart(ct: DataFrame, state: str) -> DataFrame:
    """Pie chart shown when hovering a state: product counts there."""
    return chart_series(product_counts_by_state(ct, state), "produs", "produstotal")


def discount_breakdowns(ct: DataFrame) -> DataFrame:
    """Gender and age-group breakdowns in **one** scan.

    The table is grouped once, by both columns; ``GROUPING SETS ((gender),
    (age_group))`` then run over that small result (genders x age groups), so
    no transaction is doubled. ``dimension`` tells the rows apart and ``value``
    holds the group's key (NULL keys stay NULL).

    A stream keeps one aggregate only: there the grouping sets run over its
    rows directly.
    """
    finest, measures = ct, discount_metrics()
    if not ct.isStreaming:
        finest = ct.groupBy("gender", "age_group").agg(*discount_metrics())
        measures = [
            F.sum("total_sales").alias("total_sales"),
            money_total("total_revenue").alias("total_revenue"),
            money_total("revenue_with_discount").alias("revenue_with_discount"),
            F.sum("discount_count").alias("discount_count"),
        ]
    grouped = finest.groupingSets([["gender"], ["age_group"]], "gender", "age_group").agg(
        *measures, F.grouping_id("gender", "age_group").alias("_gid")
    )
    # grouping_id bit is 1 for a column rolled up: gender set -> 1, age set -> 2
    dimension = F.when(F.col("_gid") == 1, F.lit("gender")).otherwise(F.lit("age_group"))
    value = F.when(F.col("_gid") == 1, F.col("gender")).otherwise(F.col("age_group"))
    return grouped.select(
        dimension.alias("dimension"),
        value.alias("value"),
        "total_sales",
        "total_revenue",
        "revenue_with_discount",
        "discount_count",
    )


def map_breakdowns(ct: DataFrame) -> DataFrame:
    """Every map view in **one** scan.

    The table is grouped once, by location, age group and category. ``GROUPING
    SETS ((location, age_group), (location, category), (location))`` then run
    over that small result, so no transaction is tripled: the hover bar chart
    of each state (sales per age group), its pie chart (product counts) and the
    per-state totals of the heatmap, for all states at once, instead of two
    filtered queries per hovered state plus one for the heatmap. A stream keeps
    one aggregate only: there the grouping sets run over its rows directly. Columns: ``view`` (``age_group``,
    ``product`` or ``state``), ``state``, ``key`` (the age group or the
    category; NULL on ``state`` rows), ``total_sales`` (exact sum; NULL on
    ``product`` rows; the heatmap shows it rounded) and ``produstotal``
    (count of the category; NULL on the other views).
    """
    keys = ["purchaselocation", "age_group", "product_category"]
    finest, total, count = ct, money_sum("net_amount"), F.count("product_category")
    if not ct.isStreaming:
        finest = ct.groupBy(*keys).agg(total.alias("_part"), count.alias("_parts"))
        total, count = money_total("_part"), F.sum("_parts")
    grouped = finest.groupingSets(
        [["purchaselocation", "age_group"], ["purchaselocation", "product_category"], ["purchaselocation"]], *keys
    ).agg(
        total.alias("_sum"),
        count.alias("_count"),
        F.grouping_id("purchaselocation", "age_group", "product_category").alias("_gid"),
    )
    # grouping_id bits over (location, age_group, product_category); the
    # location is never rolled up, so: 1 = age view,
    # 2 = product view, 3 = per-state totals
    view = (
        F.when(F.col("_gid") == 1, F.lit("age_group"))
        .when(F.col("_gid") == 2, F.lit("product"))
        .otherwise(F.lit("state"))
    )
    key = F.when(F.col("_gid") == 1, F.col("age_group")).when(F.col("_gid") == 2, F.col("product_category"))
    return grouped.select(
        view.alias("view"),
        F.col("purchaselocation").alias("state"),
        key.alias("key"),
        F.when(F.col("_gid") != 2, F.col("_sum")).alias("total_sales"),
        F.when(F.col("_gid") == 2, F.col("_count")).alias("produstotal"),
    )


def sales_heatmap(ct: DataFrame, states: DataFrame) -> DataFrame:
    """Heatmap page: per-location sales placed on the states dimension."""
    return state_heatmap(sales_by_state(ct), states)
