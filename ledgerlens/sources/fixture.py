"""``customer_transactions`` derived from the TPC-H-style driver tables.

One transaction per order. Columns the driver tables do not have
(gender, age group, pay date, ...) are deterministic functions of the
keys, chosen to plant the edge cases the operators must handle:

* a customer whose age group changes in 1998 (``cid % 10 = 0``),
* two customers sharing one name (``cid % 50 = 1``),
* unpaid purchases (``tid % 97 = 0``: NULL ``pay_date``),
* unknown discount flags (``tid % 103 = 0``),
* unknown category / location (``tid % 89 = 0`` / ``tid % 101 = 0``).

The same view is written as SQL in ``FIXTURE_SQL`` for the DuckDB oracle;
both produce identical rows.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import conform

# The derived-column rules of the fixture view.
DISCOUNT_RATE = Decimal("0.10")
AGE_SHIFT_FROM = "1998-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def transactions_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the fixture ``customer_transactions`` from ``orders``,
    ``customer``, ``nation``, ``lineitem`` and ``part`` under ``sf_dir``.

    Plan at scale: ``orders`` is the fact side. An order's category is the
    type of its least part key in ``lineitem`` (one row per order after a
    map-side combined aggregate); orders without lines have none. Both sides
    are grouped by their key, so Catalyst knows that they add no rows and drops
    the two left joins, scans included, from every query that does not use the
    category. All joins are left to Spark's size rule: broadcast only when a
    side's size is under the threshold, a sort-merge join that AQE can split
    otherwise. Building the view starts no job.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = (
        read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    )
    part = read_table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.min("p_type").alias("p_type"))

    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part, F.col("p_partkey") == F.col("l_partkey"), "left")
    )
    return conform(joined.select(*_derived_columns()))


def _derived_columns():
    cid = F.col("o_custkey")
    tid = F.col("o_orderkey")
    odate = F.col("o_orderdate")
    closed = F.col("o_orderstatus") != F.lit("O")
    gross = F.col("o_totalprice").cast("decimal(10,2)")
    discount = F.when(
        closed, (gross * F.lit(DISCOUNT_RATE).cast("decimal(3,2)")).cast("decimal(10,2)")
    ).otherwise(F.lit(0).cast("decimal(10,2)"))

    shifted = (
        (cid % 10 == 0) & (odate >= F.lit(AGE_SHIFT_FROM).cast("timestamp_ntz"))
    ).cast("int")
    age_key = (cid + shifted) % 5
    age_group = (
        F.when(age_key == 0, "under 18")
        .when(age_key == 1, "18-25")
        .when(age_key == 2, "25-45")
        .when(age_key == 3, "45-60")
        .otherwise("60 and above")
    )
    gender = F.when(cid % 3 == 0, "Female").when(cid % 3 == 1, "Male").otherwise("Other")
    method = F.when(tid % 3 == 0, "Credit Card").when(tid % 3 == 1, "Cash").otherwise("Debit Card")
    pay_offset = F.make_dt_interval(
        days=((cid % 31) + (tid % 7)).cast("int"), hours=(tid % 24).cast("int")
    )
    name = F.when(
        cid % 50 == 1,
        F.concat(F.lit("Customer#"), F.lpad((cid - 1).cast("string"), 9, "0")),
    ).otherwise(F.col("c_name"))

    return [
        cid.alias("cid"),
        tid.alias("tid"),
        gender.alias("gender"),
        age_group.alias("age_group"),
        odate.alias("purchase_date"),
        F.when(tid % 89 != 0, F.col("p_type")).alias("product_category"),
        F.when(tid % 103 != 0, closed).alias("discount_availed"),
        F.when(closed, F.col("o_orderpriority")).alias("discount_name"),
        discount.alias("discount_amount_inr"),
        gross.alias("gross_amount"),
        (gross - discount).cast("decimal(10,2)").alias("net_amount"),
        method.alias("purchase_method"),
        F.when(tid % 101 != 0, F.col("n_name")).alias("purchaselocation"),
        F.when(tid % 97 != 0, odate + pay_offset).alias("pay_date"),
        name.alias("client_name"),
    ]


def broken_keys_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys ``(cid, tid)`` of a load gone wrong: the fixture view's transactions
    with some keys lost and some rows loaded again. Every 499th transaction has
    no ``cid`` and every 503rd no ``tid`` (both NULL where both hold), every
    211th comes twice and every 997th three times more."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("t"))
    times = (
        F.lit(1) + F.when(F.col("t") % 211 == 0, 1).otherwise(0) + F.when(F.col("t") % 997 == 0, 3).otherwise(0)
    )
    loaded = orders.select("c", "t", F.explode(F.sequence(F.lit(1), times)).alias("load_no"))
    return loaded.select(F.when(F.col("t") % 499 != 0, F.col("c")).alias("cid"), F.when(F.col("t") % 503 != 0, F.col("t")).alias("tid"))


def states_from_tpch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``states`` dimension of the tests: nation names."""
    return read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"))


# The same view as SQL, for engines that read the driver tables directly
# (the DuckDB oracle). Kept next to the DataFrame version on purpose.
FIXTURE_SQL = """
SELECT o.o_custkey AS cid, o.o_orderkey AS tid,
  CASE o.o_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
  CASE (o.o_custkey + CASE WHEN o.o_custkey % 10 = 0 AND o.o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' THEN 1 ELSE 0 END) % 5
    WHEN 0 THEN 'under 18' WHEN 1 THEN '18-25' WHEN 2 THEN '25-45' WHEN 3 THEN '45-60' ELSE '60 and above' END AS age_group,
  o.o_orderdate AS purchase_date,
  CASE WHEN o.o_orderkey % 89 <> 0 THEN p.p_type END AS product_category,
  CASE WHEN o.o_orderkey % 103 <> 0 THEN o.o_orderstatus <> 'O' END AS discount_availed,
  CASE WHEN o.o_orderstatus <> 'O' THEN o.o_orderpriority END AS discount_name,
  CASE WHEN o.o_orderstatus <> 'O' THEN CAST(CAST(o.o_totalprice AS DECIMAL(10,2)) * CAST(0.10 AS DECIMAL(3,2)) AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END AS discount_amount_inr,
  CAST(o.o_totalprice AS DECIMAL(10,2)) AS gross_amount,
  CAST(CAST(o.o_totalprice AS DECIMAL(10,2)) - CASE WHEN o.o_orderstatus <> 'O' THEN CAST(CAST(o.o_totalprice AS DECIMAL(10,2)) * CAST(0.10 AS DECIMAL(3,2)) AS DECIMAL(10,2)) ELSE CAST(0 AS DECIMAL(10,2)) END AS DECIMAL(10,2)) AS net_amount,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'Cash' ELSE 'Debit Card' END AS purchase_method,
  CASE WHEN o.o_orderkey % 101 <> 0 THEN n.n_name END AS purchaselocation,
  CASE WHEN o.o_orderkey % 97 <> 0 THEN o.o_orderdate + (o.o_custkey % 31 + o.o_orderkey % 7) * INTERVAL '1' DAY + (o.o_orderkey % 24) * INTERVAL '1' HOUR END AS pay_date,
  CASE WHEN o.o_custkey % 50 = 1 THEN concat('Customer#', lpad(CAST(o.o_custkey - 1 AS VARCHAR(20)), 9, '0')) ELSE c.c_name END AS client_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, MIN(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN (SELECT p_partkey, MIN(p_type) AS p_type FROM part GROUP BY p_partkey) p ON p.p_partkey = l.l_partkey
"""

# The view of broken keys as SQL.
BROKEN_KEYS_SQL = """
SELECT CASE WHEN o_orderkey % 499 <> 0 THEN o_custkey END AS cid, CASE WHEN o_orderkey % 503 <> 0 THEN o_orderkey END AS tid
FROM orders, range(5) loads(k)
WHERE k < 1 + CASE WHEN o_orderkey % 211 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 997 = 0 THEN 3 ELSE 0 END
"""
