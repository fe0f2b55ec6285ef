"""Distributed row numbers against a plain sort."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import asc_sql, desc_sql, number_rows


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_equals_a_plain_sort(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, "a", "b", "ü", ""]), rng.choice([None, 1.5, -2.0])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, name string, v double")
    got = number_rows(df, [asc_sql("name"), desc_sql("v"), asc_sql("id")], partitions=parts).collect()
    key = lambda r: (r[1] is None, (r[1] or "").encode(), r[2] is not None, -(r[2] or 0), r[0])
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=key), 1)}
    assert {r["id"]: r["position"] for r in got} == want


def test_empty_single_and_repeated_rows(spark):
    one = spark.createDataFrame([(1, "x")], "id long, place string")
    assert number_rows(one.limit(0), [asc_sql("id")]).count() == 0
    assert [tuple(r) for r in number_rows(one, [asc_sql("id")], "nr").collect()] == [(1, "x", 1)]
    same = one.unionByName(one).unionByName(one)
    assert sorted(r.position for r in number_rows(same, [asc_sql("id")]).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        number_rows(one, [asc_sql("id")], "place")


def test_a_column_of_the_helper_s_own_name_survives(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, _place string")
    assert sorted(tuple(r) for r in number_rows(df, [asc_sql("id")]).collect()) == [(1, "a", 1), (2, "b", 2)]


def test_a_hot_tie_group_is_split_over_ranges(spark):
    """Equal first keys spread over the ranges once the row hash follows them,
    and no window sees the rows."""
    df = spark.range(20_000).select(F.lit("same").alias("name"), "id")
    order = [asc_sql("name"), F.xxhash64("id").asc()]
    ranged = df.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 2 * 20_000 / 8
    got = number_rows(df, order, partitions=8)
    assert [r.position for r in got.orderBy("position").collect()] == list(range(1, 20_001))
    # the only window runs over one row per range
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Aggregate" in plan.split("Window", 1)[1]
