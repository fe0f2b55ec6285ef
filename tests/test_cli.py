"""The batch command line runs each request against a stored table and
writes the same rows the operator returns."""

import pytest

from conftest import SF001
from ledgerlens import estimate_cash_flow, top_loyal_customers
from ledgerlens.cli import run
from ledgerlens.sources import read_transactions_parquet, transactions_from_tpch, write_transactions


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "ct")
    write_transactions(transactions_from_tpch(spark, SF001), path)
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_top_loyal_json(spark, table, tmp_path):
    out = str(tmp_path / "top")
    res = run(spark, ["top-loyal", "--table", table, "--out", out, "--k", "5", "--criteria", "PURCHASE_FREQUENCY"])
    back = spark.read.schema(res.schema).json(out)
    want = top_loyal_customers(read_transactions_parquet(spark, table), 5, "purchase_frequency")
    assert _rows(back) == _rows(want)


def test_forecast_parquet_and_bounds(spark, table, tmp_path):
    out = str(tmp_path / "fc")
    run(spark, ["forecast", "--table", table, "--out", out, "--out-format", "parquet", "--months-ahead", "3"])
    want = estimate_cash_flow(read_transactions_parquet(spark, table), 3)
    assert _rows(spark.read.parquet(out)) == _rows(want)
    with pytest.raises(ValueError):
        run(spark, ["forecast", "--table", table, "--out", str(tmp_path / "bad"), "--months-ahead", "13"])


@pytest.mark.parametrize(
    "argv",
    [
        ["customers", "--age-group", "18-25", "--sort-by", "total_spent", "--descending"],
        ["discounts-gender"],
        ["discounts-age"],
        ["discounts-type"],
        ["cash-flow"],
        ["trend", "--months-ahead", "2"],
        ["state-age", "--state", "NATION_3"],
        ["state-products"],
        ["state-sales"],
        ["legend"],
        ["maps"],
        ["discounts-all"],
        ["key-check"],
    ],
)
def test_every_command_writes(spark, table, tmp_path, argv):
    out = str(tmp_path / "out")
    res = run(spark, [argv[0], "--table", table, "--out", out, *argv[1:]])
    assert spark.read.schema(res.schema).json(out).count() == res.count()


def test_heatmap_needs_states(spark, table, tmp_path):
    states = str(tmp_path / "states")
    spark.read.parquet(f"{SF001}/nation.parquet").selectExpr("n_name AS state").write.parquet(states)
    out = str(tmp_path / "hm")
    res = run(spark, ["heatmap", "--table", table, "--out", out, "--states", states])
    assert spark.read.schema(res.schema).json(out).count() == 25
    with pytest.raises(ValueError):
        run(spark, ["heatmap", "--table", table, "--out", str(tmp_path / "x")])


def test_csv_table_input(spark, table, tmp_path):
    csv_dir = str(tmp_path / "ct_csv")
    (
        read_transactions_parquet(spark, table)
        .write.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("nullValue", "")
        .csv(csv_dir)
    )
    out = str(tmp_path / "sales")
    res = run(spark, ["state-sales", "--table", csv_dir, "--format", "csv", "--out", out, "--out-format", "parquet"])
    from ledgerlens import sales_by_state

    assert _rows(spark.read.parquet(out)) == _rows(sales_by_state(read_transactions_parquet(spark, table)))
    assert res.count() > 0
