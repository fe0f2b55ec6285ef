"""Sources and sinks: CSV and Parquet round trips, JSON output, JDBC
options (no database is available here, so only the options are
checked)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ledgerlens.schema import CT_COLUMNS, CT_SCHEMA, conform
from ledgerlens.sources import (
    jdbc_options,
    read_transactions_csv,
    read_transactions_parquet,
    to_json_rows,
    transactions_from_tpch,
    write_json,
    write_transactions,
    write_transactions_csv,
)
from ledgerlens import sales_by_state


def _sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fixture_has_table_schema(spark):
    ct = transactions_from_tpch(spark, SF001)
    assert ct.columns == CT_COLUMNS
    assert [f.dataType for f in ct.schema.fields] == [f.dataType for f in CT_SCHEMA.fields]


def test_csv_round_trip(spark, tmp_path):
    ct = transactions_from_tpch(spark, SF001)
    path = str(tmp_path / "ct_csv")
    write_transactions_csv(ct, path)
    back = read_transactions_csv(spark, path)
    assert back.schema.simpleString() == CT_SCHEMA.simpleString()
    assert _sorted_rows(back) == _sorted_rows(ct)


def test_csv_failfast_on_bad_row(spark, tmp_path):
    p = tmp_path / "bad.csv"
    header = ",".join(CT_COLUMNS)
    p.write_text(header + "\n" + "notanumber" + ",1" * (len(CT_COLUMNS) - 1) + "\n")
    with pytest.raises(Exception):
        read_transactions_csv(spark, str(p)).collect()


def test_parquet_round_trip_and_conform(spark, tmp_path):
    ct = transactions_from_tpch(spark, SF001)
    path = str(tmp_path / "ct_parquet")
    write_transactions(ct, path)
    back = read_transactions_parquet(spark, path)
    assert back.columns == CT_COLUMNS
    assert _sorted_rows(back) == _sorted_rows(ct)
    with pytest.raises(ValueError):
        conform(back.drop("tid"))


def test_json_sink(spark, tmp_path):
    ct = transactions_from_tpch(spark, SF001)
    sales = sales_by_state(ct)
    path = str(tmp_path / "sales_json")
    write_json(sales, path)
    back = spark.read.schema(sales.schema).json(path)
    assert _sorted_rows(back) == _sorted_rows(sales)
    first = json.loads(to_json_rows(sales.filter(F.col("state").isNotNull())).first().value)
    assert set(first) == {"state", "total_sales"}
    assert isinstance(first["total_sales"], (int, float))


def test_jdbc_slices_hold_every_row_once():
    """Both SQL texts run in DuckDB, over a table with a hot customer."""
    import duckdb

    from ledgerlens.sources.tables import key_slices_query, slice_predicates

    db = duckdb.connect()
    db.sql("CREATE TABLE ct AS SELECT CASE WHEN i % 3 = 0 THEN 7 ELSE i % 50 END AS cid, i AS tid FROM range(3000) t(i)")
    starts = db.sql(key_slices_query("ct", 8)).fetchall()
    counts = [db.sql(f"SELECT COUNT(*) FROM ct WHERE {p}").fetchall()[0][0] for p in slice_predicates(starts)]
    assert counts == [375] * 8
    db.sql("INSERT INTO ct VALUES (NULL, 1), (1, NULL), (NULL, NULL), (99, NULL)")
    counts = [db.sql(f"SELECT COUNT(*) FROM ct WHERE {p}").fetchall()[0][0] for p in slice_predicates(starts)]
    assert counts == [379] + [375] * 7
    assert slice_predicates([]) == ["1 = 1"]


def test_empty_location_is_not_null_in_the_stored_layout(spark, tmp_path):
    ct = transactions_from_tpch(spark, SF001).withColumn(
        "purchaselocation",
        F.when(F.col("tid") % 4 == 0, F.lit("")).when(F.col("tid") % 4 == 1, F.lit(None)).when(F.col("tid") % 4 == 2, F.lit("007")).otherwise(F.lit("_")),
    )
    path = str(tmp_path / "layout")
    write_transactions(ct, path, num_files=3)
    assert _sorted_rows(read_transactions_parquet(spark, path)) == _sorted_rows(ct)


def test_jdbc_options():
    o = jdbc_options(
        "jdbc:postgresql://db:5432/bi", lower_bound=1, upper_bound=1000, num_partitions=16, user="u", password="p"
    )
    assert o["partitionColumn"] == "tid"
    assert o["numPartitions"] == "16"
    assert o["dbtable"] == "customer_transactions"
    assert o["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", lower_bound=5, upper_bound=1, num_partitions=2)
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", lower_bound=1, upper_bound=5, num_partitions=0)


def _file_ranges(files, column):
    import pyarrow.parquet as pq

    out = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        col = meta.schema.names.index(column)
        stats = [meta.row_group(i).column(col).statistics for i in range(meta.num_row_groups)]
        vals = [(st.min, st.max) for st in stats if st is not None and st.has_min_max]
        if vals:
            out.append((min(v[0] for v in vals), max(v[1] for v in vals)))
    return sorted(out)


def test_stored_layout_location_directories_and_customer_ranges(spark, tmp_path):
    import glob

    ct = transactions_from_tpch(spark, SF001)
    path = str(tmp_path / "ct_layout")
    write_transactions(ct, path, num_files=4)
    dirs = sorted(d for d in os.listdir(path) if d.startswith("location_dir="))
    assert len(dirs) == ct.select("purchaselocation").distinct().count()  # NULL gets its own directory
    for d in dirs:
        # within a location, files hold ordered cid ranges: neighbours may
        # share only a boundary customer (split on tid), never interleave
        ranges = _file_ranges(sorted(glob.glob(os.path.join(path, d, "*.parquet"))), "cid")
        for (lo1, hi1), (lo2, hi2) in zip(ranges, ranges[1:]):
            assert hi1 <= lo2
    back = read_transactions_parquet(spark, path)
    assert back.columns == CT_COLUMNS
    assert _sorted_rows(back) == _sorted_rows(ct)
    q = back.filter(F.col("purchaselocation") == "NATION_3")
    plan = q._sc._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(location_dir" in plan and "= NATION_3)" in plan
    with pytest.raises(ValueError):
        write_transactions(ct, str(tmp_path / "x"), num_files=0)


def test_stored_layout_splits_a_hot_location_and_customer(spark, tmp_path):
    import glob

    ct = transactions_from_tpch(spark, SF001).withColumn("purchaselocation", F.lit("HOT")).withColumn("cid", F.lit(7).cast("bigint"))
    path = str(tmp_path / "ct_hot")
    write_transactions(ct, path, num_files=4)
    files = sorted(glob.glob(os.path.join(path, "location_dir=_HOT", "*.parquet")))
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(sizes) == 4 and max(sizes) < ct.count()


def test_json_keeps_null_fields(spark, tmp_path):
    from ledgerlens.sources.tables import to_json_rows, write_json

    df = spark.createDataFrame([(None, 2), ("X", None)], "state string, total_sales int")
    want = {'{"state":null,"total_sales":2}', '{"state":"X","total_sales":null}'}
    assert {r.value for r in to_json_rows(df).collect()} == want
    write_json(df, str(tmp_path / "out"))
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} == want


def test_csv_columns_are_found_by_name(spark, tmp_path, make_ct):
    from ledgerlens.sources.tables import read_transactions_csv

    ct = make_ct([{"gender": "Male", "age_group": "18-25"}])
    cols = ["age_group", "gender", *[c for c in ct.columns if c not in ("age_group", "gender")]]
    ct.select(*cols).write.option("header", True).csv(str(tmp_path / "csv"))
    row = read_transactions_csv(spark, str(tmp_path / "csv")).first()
    assert (row.gender, row.age_group) == ("Male", "18-25")
    ct.drop("gender").write.option("header", True).csv(str(tmp_path / "less"))
    with pytest.raises(ValueError):
        read_transactions_csv(spark, str(tmp_path / "less"))


def test_csv_files_keep_fractions_quotes_and_nulls(spark, tmp_path, make_ct):
    from datetime import datetime
    from decimal import Decimal

    ct = make_ct(
        [
            {"client_name": 'a "quoted", name', "purchase_date": datetime(2020, 2, 29, 23, 59, 59, 123456), "net_amount": Decimal("-0.01")},
            {"client_name": "  padded  ", "gender": "None", "discount_availed": False},
            {"client_name": None, "discount_availed": None},
        ]
    )
    path = str(tmp_path / "csv")
    write_transactions_csv(ct.withColumn("more", F.lit(1)).repartition(2), path)
    assert _sorted_rows(read_transactions_csv(spark, path)) == _sorted_rows(ct)
    empty = str(tmp_path / "empty")
    write_transactions_csv(ct.limit(0), empty)
    assert read_transactions_csv(spark, empty).count() == 0


def _rows_read(df) -> int:
    """Rows that the scan handed on, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes, found = [plan], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    assert len(found) == 1
    return found[0]


def test_a_customer_lookup_skips_row_groups(spark, tmp_path):
    """Even cids only: an odd one lies between the least and greatest cid of its
    row group, so only the Bloom filter can tell that it is not there."""
    from ledgerlens.sources.tables import write_transactions as write

    ct = transactions_from_tpch(spark, SF001).withColumn("cid", F.col("cid") * 2).withColumn("purchaselocation", F.lit("X"))
    path = str(tmp_path / "bloom")
    # so few customers would be dictionary encoded, and need no filter
    plain = "parquet.enable.dictionary#cid"
    spark.conf.set(plain, "false")
    try:
        write(ct, path, num_files=2)
    finally:
        spark.conf.unset(plain)
    back = read_transactions_parquet(spark, path)
    some = back.agg(F.min(F.when(F.col("cid") > 50, F.col("cid"))).alias("c")).first().c
    odd, there = (back.filter(F.col("cid") == c).select("tid") for c in (some + 1, some))
    assert _rows_read(odd) == 0 and odd.count() == 0
    assert _rows_read(there) > 0 and there.count() == ct.filter(F.col("cid") == some).count()
    key = "parquet.filter.bloom.enabled"
    without = spark.read.option(key, "false").parquet(path).filter(F.col("cid") == some + 1).select("tid")
    assert _rows_read(without) > 0 and without.count() == 0
    # filters follow the number of customers: small files stay small
    assert sum(f.stat().st_size for f in (tmp_path / "bloom").rglob("*.parquet")) < 400_000
