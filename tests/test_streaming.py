"""Streaming aggregates equal the batch ones over the same files, also
when the files arrive over several micro-batches."""

import os

import pytest

from conftest import SF001
from ledgerlens import sales_by_state
from ledgerlens.sources import read_transactions_parquet, transactions_from_tpch
from ledgerlens.streaming import STREAMABLE, read_latest_snapshot, start_dashboard_stream


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """The sf0.001 fixture view written as several files, as a landing folder."""
    path = str(tmp_path_factory.mktemp("landing") / "ct")
    transactions_from_tpch(spark, SF001).repartition(4, "tid").write.parquet(path)
    return path


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(set(STREAMABLE) - {"top_loyal_customers"}))
def test_stream_equals_batch(spark, landed, tmp_path, name):
    q = start_dashboard_stream(
        spark,
        landed,
        name,
        checkpoint_location=str(tmp_path / "cp"),
        available_now=True,
        max_files_per_trigger=1,
    )
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.sql(f"SELECT * FROM {name}")
    want = STREAMABLE[name](read_transactions_parquet(spark, landed))
    assert _rows(got) == _rows(want)
    assert q.lastProgress is not None


def test_streamed_ranking_with_params_and_rocksdb(spark, landed, tmp_path):
    from ledgerlens import top_loyal_customers
    from ledgerlens.session import ROCKSDB_STATE_STORE

    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB_STATE_STORE)
    try:
        q = start_dashboard_stream(
            spark, landed, "top_loyal_customers", checkpoint_location=str(tmp_path / "cp"),
            available_now=True, max_files_per_trigger=1, k=7, criteria="purchase_frequency",
        )
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)
    got = spark.sql("SELECT * FROM top_loyal_customers")
    want = top_loyal_customers(read_transactions_parquet(spark, landed), 7, "purchase_frequency")
    assert _rows(got) == _rows(want)


def test_snapshot_sink_and_restart(spark, landed, tmp_path):
    import os

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    q = start_dashboard_stream(
        spark, landed, "sales_by_state", out, cp, available_now=True, max_files_per_trigger=1, keep_last=2
    )
    q.awaitTermination(300)
    assert q.exception() is None
    first = _rows(read_latest_snapshot(spark, out))
    want = STREAMABLE["sales_by_state"](read_transactions_parquet(spark, landed))
    assert first == _rows(want)
    # four files, one per micro-batch: only the last two snapshots are kept
    assert len([d for d in os.listdir(out) if d.startswith("run-000001-epoch-")]) == 2
    # restart from the checkpoint: nothing new, result unchanged
    q = start_dashboard_stream(spark, landed, "sales_by_state", out, cp, available_now=True)
    q.awaitTermination(300)
    assert _rows(read_latest_snapshot(spark, out)) == first


def test_streams_with_other_parameters_have_their_own_state(spark, landed, tmp_path):
    ct = read_transactions_parquet(spark, landed)
    states = [r[0] for r in ct.select("purchaselocation").dropna().distinct().orderBy("purchaselocation").limit(2).collect()]
    for i, state in enumerate(states):
        out = str(tmp_path / f"out{i}")
        start_dashboard_stream(spark, landed, "age_group_sales_by_state", out, available_now=True, state=state).awaitTermination(300)
        assert _rows(read_latest_snapshot(spark, out)) == _rows(STREAMABLE["age_group_sales_by_state"](ct, state=state))


def test_new_checkpoint_on_an_old_output_serves_the_new_rows(spark, landed, tmp_path):
    ct = read_transactions_parquet(spark, landed)
    more, out = str(tmp_path / "more"), str(tmp_path / "out")
    ct.repartition(3).write.parquet(more)
    start_dashboard_stream(spark, more, "sales_by_state", out, str(tmp_path / "a"), available_now=True, max_files_per_trigger=1, keep_last=2).awaitTermination(300)
    ct.limit(50).write.mode("append").parquet(more)
    start_dashboard_stream(spark, more, "sales_by_state", out, str(tmp_path / "b"), available_now=True, keep_last=2).awaitTermination(300)
    want = STREAMABLE["sales_by_state"](read_transactions_parquet(spark, more))
    assert _rows(read_latest_snapshot(spark, out)) == _rows(want)


def test_csv_landing_folder(spark, landed, tmp_path):
    csv_dir = str(tmp_path / "csv")
    (
        read_transactions_parquet(spark, landed)
        .repartition(3)
        .write.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("nullValue", "")
        .csv(csv_dir)
    )
    q = start_dashboard_stream(
        spark, csv_dir, "discounts_by_gender", checkpoint_location=str(tmp_path / "cp"),
        available_now=True, file_format="csv",
    )
    q.awaitTermination(300)
    assert q.exception() is None
    want = STREAMABLE["discounts_by_gender"](read_transactions_parquet(spark, landed))
    assert _rows(spark.sql("SELECT * FROM discounts_by_gender")) == _rows(want)


def test_not_streamable(spark, landed):
    with pytest.raises(ValueError):
        start_dashboard_stream(spark, landed, "customer_summary")


def test_snapshots_are_ordered_by_run_and_epoch_not_by_time(spark, tmp_path):
    """A stream with a new checkpoint starts its epochs again; its snapshot is
    the newest one although clocks say otherwise."""
    ct = transactions_from_tpch(spark, SF001)
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ct.write.parquet(src)

    def run(checkpoint):
        q = start_dashboard_stream(
            spark, src, "sales_by_state", out, checkpoint_location=str(tmp_path / checkpoint), available_now=True
        )
        q.awaitTermination(120)

    run("a")
    ct.limit(10).write.mode("append").parquet(src)
    run("a")  # goes on: run 1, epoch 1
    run("b")  # a new checkpoint: run 2, epoch 0
    names = sorted(d for d in os.listdir(out) if d.startswith("run-"))
    assert [n.split("-") for n in names] == [
        ["run", "000001", "epoch", "0" * 12], ["run", "000001", "epoch", "0" * 11 + "1"], ["run", "000002", "epoch", "0" * 12]
    ]
    for n in names:
        os.utime(os.path.join(out, n, "_SUCCESS"), (1, 1) if n.startswith("run-000002") else None)
    want = sales_by_state(spark.read.schema(ct.schema).parquet(src))
    assert _rows(read_latest_snapshot(spark, out)) == _rows(want)
