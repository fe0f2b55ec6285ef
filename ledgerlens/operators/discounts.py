"""Discount operators: sales and discounted revenue per gender, per age
group, and per discount type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import count_true, desc_sql, exact_mean, money_sum, sum_if_true


def discount_metrics():
    """The four per-group measures shared by the gender and age breakdowns.

    A NULL ``discount_availed`` counts as not discounted.
    """
    return [
        F.count("tid").alias("total_sales"),
        money_sum("net_amount").alias("total_revenue"),
        sum_if_true("discount_availed", "net_amount").alias("revenue_with_discount"),
        count_true("discount_availed").alias("discount_count"),
    ]


def discounts_by(df: DataFrame, key: str) -> DataFrame:
    """Discount measures per value of ``key`` (NULL is one group); no
    filter, no order. One partial/final hash aggregate, one shuffle of at
    most (tasks x groups) rows."""
    return df.groupBy(key).agg(*discount_metrics())


def discounts_by_gender(df: DataFrame) -> DataFrame:
    return discounts_by(df, "gender")


def discounts_by_age_group(df: DataFrame) -> DataFrame:
    return discounts_by(df, "age_group")


def sales_by_discount(df: DataFrame) -> DataFrame:
    """Per ``discount_name`` over discounted rows only (a NULL flag is
    dropped; a NULL name is its own group): count, revenue, and the mean
    discount amount. Ordered by revenue, highest first (NULL first).

    The boolean filter is pushed into the Parquet scan.
    """
    return (
        df.filter(F.col("discount_availed") == F.lit(True))
        .groupBy("discount_name")
        .agg(
            F.count("tid").alias("total_sales"),
            money_sum("net_amount").alias("total_revenue"),
            exact_mean("discount_amount_inr").alias("average_discount_amount"),
        )
        .orderBy(desc_sql("total_revenue"))
    )
