"""Sorted results with the place of every row as a column.

A DataFrame's row order is lost as soon as it is written to several files or
joined; ``position`` (from 1) keeps it. The order is the one in which each
result is shown, ended by keys that tell its rows apart, so positions are
unique and the same in every run. NULLs are placed as SQL places them: last on
ascending, first on descending.

Results that are bounded by a dimension (months, locations, discount types,
the top k) are numbered in a few ranges; customers in as many as the session
has shuffle partitions (:func:`ledgerlens.functions.ordinal.number_rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.functions.columns import asc_sql, desc_sql
from ledgerlens.functions.ordinal import number_rows
from ledgerlens.operators.cashflow import cash_flow_trend, historical_cash_flow
from ledgerlens.operators.customers import SORTABLE_COLUMNS, loyalty_criterion, sort_customers, summary_rows, top_loyal_customers
from ledgerlens.operators.discounts import sales_by_discount
from ledgerlens.operators.geo import PRODUCT_COLUMN, age_group_sales_by_state, product_counts_by_state, sales_by_state

POSITION = "position"
_BOUNDED = 4  # ranges of a result that a dimension bounds


def _bounded(df: DataFrame, *order) -> DataFrame:
    return number_rows(df, order, POSITION, _BOUNDED)


def top_loyal_positions(ct: DataFrame, k: int, criteria: str = "combined") -> DataFrame:
    """The loyalty ranking with each name's rank; equal scores by name."""
    crit = loyalty_criterion(criteria)
    key = "loyalty_score" if crit == "combined" else crit
    return _bounded(top_loyal_customers(ct, k, criteria), desc_sql(key), asc_sql("client_name"))


def customer_summary_positions(ct: DataFrame) -> DataFrame:
    """The customer summary by name, then by ``cid``, age group and gender,
    which together are a summary row's key."""
    order = [asc_sql(c) for c in ("client_name", "cid", "age_group", "gender")]
    return number_rows(summary_rows(ct), order, POSITION).drop("cid")


def sort_customers_positions(summary: DataFrame, column: str = "client_name", ascending: bool = True) -> DataFrame:
    """The customer table in the order of :func:`sort_customers`. Ties go on by
    all other columns in table order, so only identical rows tie."""
    sort_customers(summary, column, ascending)  # checks the column
    first = asc_sql(column) if ascending else desc_sql(column)
    rest = [asc_sql(c) for c in SORTABLE_COLUMNS if c != column]
    return number_rows(summary, [first, *rest], POSITION)


def sales_by_discount_positions(ct: DataFrame) -> DataFrame:
    """Discount types by revenue, highest first."""
    return _bounded(sales_by_discount(ct), desc_sql("total_revenue"), asc_sql("discount_name"))


def historical_cash_flow_positions(ct: DataFrame) -> DataFrame:
    """Months in time order, the NULL month last."""
    return _bounded(historical_cash_flow(ct), asc_sql("month"))


def cash_flow_trend_positions(ct: DataFrame, months_ahead: int = 6) -> DataFrame:
    """The trend series by month number."""
    return _bounded(cash_flow_trend(ct, months_ahead), asc_sql("month_no"))


def age_group_sales_positions(ct: DataFrame, state: str | None = None) -> DataFrame:
    """Sales per state and age group, by both."""
    return _bounded(age_group_sales_by_state(ct, state), asc_sql("state"), asc_sql("age_group"))


def product_counts_positions(ct: DataFrame, state: str | None = None) -> DataFrame:
    """Product counts per state and category, by both."""
    return _bounded(product_counts_by_state(ct, state), asc_sql("state"), asc_sql(PRODUCT_COLUMN))


def sales_by_state_positions(ct: DataFrame) -> DataFrame:
    """Sales per state, by state."""
    return _bounded(sales_by_state(ct), asc_sql("state"))
