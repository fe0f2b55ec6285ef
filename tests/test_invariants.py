"""
and 4)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens import (
    age_group_sales_by_state,
    customer_summary,
    discounts_by_age_group,
    discounts_by_gender,
    historical_cash_flow,
    sales_by_state,
)
from ledgerlens.plans import discount_breakdowns, map_breakdowns
from ledgerlens.sources import transactions_from_tpch


@pytest.fixture(scope="module")
def ct(spark):
    return transactions_from_tpch(spark, SF01).cache()


def _sum(df, c):
    return df.agg(F.sum(c)).first()[0]


def test_breakdowns_partition_the_rows(ct):
    n = ct.count()
    assert _sum(discounts_by_gender(ct), "total_sales") == n
    assert _sum(discounts_by_age_group(ct), "total_sales") == n
    both = discount_breakdowns(ct)
    assert _sum(both.filter("dimension = 'gender'"), "total_sales") == n
    assert _sum(both.filter("dimension = 'age_group'"), "total_sales") == n


def test_money_totals_agree(ct):
    total = _sum(ct, "net_amount")
    assert _sum(historical_cash_flow(ct), "total_cash_flow") == total
    assert _sum(age_group_sales_by_state(ct), "total_sales") == total
    assert _sum(discounts_by_gender(ct), "total_revenue") == total


def test_summary_covers_every_customer(ct):
    summary = customer_summary(ct)
    assert summary.count() >= ct.select("cid").distinct().count()


def test_results_do_not_depend_on_session_zone(spark, ct):
    def snapshot():
        a = sorted((tuple(r) for r in customer_summary(ct).collect()), key=repr)
        b = [tuple(r) for r in historical_cash_flow(ct).collect()]
        c = sorted((tuple(r) for r in sales_by_state(ct).collect()), key=repr)
        return a, b, c

    old = spark.conf.get("spark.sql.session.timeZone")
    utc = snapshot()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        dst = snapshot()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert utc == dst


def test_map_breakdowns_equal_the_separate_views(ct):
    from ledgerlens import product_counts_by_state

    mb = map_breakdowns(ct)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    age = mb.filter("view = 'age_group'").selectExpr("state", "key AS age_group", "total_sales")
    assert rows(age) == rows(age_group_sales_by_state(ct))
    prod = mb.filter("view = 'product'").selectExpr("state", "key AS produs", "produstotal")
    assert rows(prod) == rows(product_counts_by_state(ct))
    tot = mb.filter("view = 'state'").select(
        "state", F.round("total_sales", 0).cast("decimal(38,0)").alias("total_sales")
    )
    assert rows(tot) == rows(sales_by_state(ct))
