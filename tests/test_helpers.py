"""Helpers: cluster sizing, shared folder, columns."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.columns import asc_sql, delay_micros, desc_sql, exact_mean, month_start
from ledgerlens.session import recommended_conf, scratch_dir, shared_dir


def test_recommended_conf_scales_with_input():
    tb = 100 * 10**12
    c = recommended_conf(tb, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 16_000
    # every map task keeps a status per shuffle partition
    maps = -(-tb // int(c["spark.sql.files.maxPartitionBytes"]))
    assert maps * int(c["spark.sql.shuffle.partitions"]) <= 2 * 10**9
    assert int(recommended_conf(tb, 8000, 10**13)["spark.sql.shuffle.partitions"]) == -(-(10**13) // (256 << 20))
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = recommended_conf(10**6, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16


def test_shared_dir_comes_from_session(spark):
    base = shared_dir(spark)
    assert base and shared_dir(spark, "streams", "q").startswith(base)
    assert scratch_dir(spark) == base


def test_only_a_local_session_gets_a_folder_of_its_own(monkeypatch):
    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, d):
            self.dir = d

    class Session:
        def __init__(self, master):
            self.sparkContext, self.set_to = Context(master), {}
            self.conf = self

        def get(self, k, default=None):
            return self.set_to.get(k, default)

        def set(self, k, v):
            self.set_to[k] = v

    with pytest.raises(RuntimeError):
        scratch_dir(Session("spark://host:7077"))
    local = Session("local[4]")
    assert scratch_dir(local) == scratch_dir(local) == local.set_to["spark.checkpoint.dir"]


def test_null_ordering_helpers(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in df.orderBy(asc_sql("x")).collect()] == [1, 2, None]
    assert [r.x for r in df.orderBy(desc_sql("x")).collect()] == [None, 2, 1]


def test_exact_mean_and_delay(spark):
    df = spark.createDataFrame(
        [
            (Decimal("0.10"), datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 0, 0, 1)),
            (Decimal("0.20"), datetime(2020, 3, 31, 23, 59, 59), None),
        ],
        "a decimal(10,2), p timestamp_ntz, q timestamp_ntz",
    )
    row = df.agg(
        exact_mean("a").alias("m"),
        F.sum(delay_micros("q", "p")).alias("d"),
        F.min(month_start("p")).alias("m1"),
        F.max(month_start("p")).alias("m2"),
    ).first()
    assert row.m == float(Decimal("0.30")) / 2
    assert row.d == 1
    assert (row.m1, row.m2) == (datetime(2020, 1, 1), datetime(2020, 3, 1))


def test_apply_recommended_conf_keeps_launch_values(spark):
    from ledgerlens.session import apply_recommended_conf

    old = {k: spark.conf.get(k, None) for k in recommended_conf(10**9, 8)}
    try:
        applied = apply_recommended_conf(spark, 10**9, 8)
        # the test session set shuffle partitions at launch: kept
        assert "spark.sql.shuffle.partitions" not in applied
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(128 << 20)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
