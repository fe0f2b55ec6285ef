"""Physical-plan checks: the plans we want at scale, not just the rows."""


import re

import pytest

from conftest import SF01

import __spark_entry__ as E
from ledgerlens import (
    age_group_sales_by_state,
    classify_payers,
    customer_summary,
    filter_customers,
    sales_by_discount,
    sort_customers,
    top_loyal_customers,
)
from ledgerlens.plans import customer_table, discount_breakdowns, map_breakdowns
from ledgerlens.sources import read_transactions_parquet, transactions_from_tpch, write_transactions


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def tree(df) -> str:
    """Only the operator tree of the formatted plan (not the node details)."""
    return formatted(df).split("\n\n", 1)[0]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ct") / "customer_transactions")
    write_transactions(transactions_from_tpch(spark, SF01), path, num_files=8)
    return read_transactions_parquet(spark, path)


@pytest.mark.parametrize("name", sorted(E.core_queries()))
def test_no_python_udf_no_cartesian(spark, name):
    p = formatted(E.core_queries()[name](spark, SF01))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, f"{name}: {bad}"


def test_top_k_is_take_ordered(table):
    p = formatted(top_loyal_customers(table, 10, "total_spent"))
    assert "TakeOrderedAndProject" in p


def final(df) -> str:
    """The plan that ran."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize(
    "query",
    [
        customer_summary,
        lambda ct: classify_payers(customer_summary(ct), 15),
        lambda ct: filter_customers(customer_summary(ct), "18-25", "Male"),
        lambda ct: sort_customers(customer_summary(ct), "total_spent", False),
        lambda ct: customer_table(ct, 15, "18-25", "", "avg_payment_delay", False),
    ],
)
def test_summary_scans_once_and_joins_without_a_window(table, query):
    p = final(query(table))
    assert "Window" not in p
    assert p.count("FileScan") == 1 and p.count("ReusedExchange") == 1
    assert len(re.findall(r"SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin", p)) == 1
    # partial aggregate before the shuffle, for profiles and for totals
    assert p.count("partial_") >= 2


def test_state_filter_and_columns_reach_the_scan(table):
    p = formatted(age_group_sales_by_state(table, "NATION_3"))
    # the stored layout has one directory per location: an exact partition filter
    assert "PartitionFilters: [isnotnull(location_dir" in p and "= NATION_3)]" in p
    read_schema = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all("client_name" not in s and "pay_date" not in s for s in read_schema)


def test_boolean_filter_pushed(table):
    p = formatted(sales_by_discount(table))
    assert "EqualTo(discount_availed,true)" in p


@pytest.mark.parametrize("query", [discount_breakdowns, map_breakdowns])
def test_breakdowns_share_one_scan_and_expand_only_groups(table, query):
    p = tree(query(table))
    assert p.count("Scan parquet") == 1 and p.count("Expand") == 1
    # below the grouping sets is the finished finest grouping, not the scan
    below = p.split("Expand", 1)[1]
    assert below.count("HashAggregate") == 2 and below.count("Exchange") == 1


@pytest.mark.parametrize("name", sorted(E.core_queries()))
def test_lineitem_and_part_are_read_for_products_only(spark, name):
    if name in ("key_violations", "transaction_key_violations"):
        return
    if name.endswith("_positions") or "round_trip" in name or name == "json_file_rows":
        return  # these read a table that they have written
    p = formatted(E.core_queries()[name](spark, SF01))
    products = "product" in name or name == "map_breakdowns"
    assert ("lineitem.parquet" in p) == products, name
    assert ("part.parquet" in p) == products, name


def test_category_comes_from_all_parts(spark):
    ct = transactions_from_tpch(spark, SF01)
    part = spark.read.parquet(f"{SF01}/part.parquet").filter("p_partkey > 199").select("p_type").distinct()
    assert ct.count() == spark.read.parquet(f"{SF01}/orders.parquet").count()
    assert ct.join(part, ct.product_category == part.p_type, "left_semi").count() > 0
    assert "(p_partkey,199)" not in formatted(ct) and "(p_partkey,-199)" not in formatted(ct)
