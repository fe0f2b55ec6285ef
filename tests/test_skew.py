"""A key holding a third of all rows: results stay whole and the work is
split. The hot input is derived from the driver tables (one customer
takes over every third order)."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from ledgerlens import customer_summary, top_loyal_customers
from ledgerlens.sources import transactions_from_tpch

HOT_CID = 1


@pytest.fixture(scope="module")
def hot_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("hot_sf")
    for t in ("customer", "nation", "part", "lineitem"):
        os.symlink(os.path.join(SF01, f"{t}.parquet"), d / f"{t}.parquet")
    orders = spark.read.parquet(os.path.join(SF01, "orders.parquet"))
    hot = orders.withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT_CID)).otherwise(F.col("o_custkey"))
    )
    hot.repartition(8).write.parquet(str(d / "orders.parquet"))
    return str(d)


def _final_plan(df):
    """Run the DataFrame's own execution (small here), then read its final
    adaptive plan."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_join_is_split(spark, hot_dir):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        ct = transactions_from_tpch(spark, hot_dir)
        plan = _final_plan(ct.select("cid", "net_amount"))
        assert "SortMergeJoin" in plan
        assert "isSkewJoin=true" in plan.replace(" ", "") or "skew=true" in plan
        n = ct.count()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert n == 15000
    assert ct.filter(F.col("cid") == HOT_CID).count() >= 5000


def test_hot_customer_results_whole(spark, hot_dir):
    ct = transactions_from_tpch(spark, hot_dir)
    hot_rows = ct.filter(F.col("cid") == HOT_CID).count()
    summary = customer_summary(ct).filter(F.col("client_name") == "Customer#000000000")
    # cid 1 is one of the planted shared names (cid % 50 = 1 -> name of cid 0)
    freqs = {r.purchase_frequency for r in summary.collect()}
    assert hot_rows in freqs
    top = top_loyal_customers(ct, 1, "purchase_frequency").first()
    assert top.purchase_frequency >= hot_rows


def test_hot_customer_with_many_profiles_is_split(spark, hot_dir):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    ct = transactions_from_tpch(spark, hot_dir)
    names = F.when(F.col("cid") == HOT_CID, F.concat(F.lit("guest "), F.col("tid"))).otherwise(F.col("client_name"))
    ct = ct.withColumn("client_name", names)
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = customer_summary(ct)
        plan = _final_plan(got)
        assert "Window" not in plan and "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    hot = ct.filter(F.col("cid") == HOT_CID).count()
    rows = got.filter(F.col("client_name").startswith("guest ")).collect()
    assert len(rows) == hot and {r.purchase_frequency for r in rows} == {hot}
