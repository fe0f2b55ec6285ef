"""Session helpers: a local session for tests/bench, and the shared
folder for anything that must outlive an executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROCKSDB_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, checkpoint_dir: str | None = None, **conf) -> SparkSession:
    """A local session configured like the cluster one: UTC session zone,
    AQE on, no web UI. ``checkpoint_dir`` is set only if the session does
    not already name one."""
    b = (
        SparkSession.builder.master(master)
        .appName("ledgerlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir and not shared_dir_or_none(spark):
        spark.conf.set(CHECKPOINT_CONF, checkpoint_dir)
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def recommended_conf(input_bytes: int, total_cores: int, shuffled_bytes: int = 0) -> dict[str, str]:
    """Session settings for a scan of ``input_bytes`` on ``total_cores``.

    * Scan splits of 1 GiB: a 100 TB table becomes ~100k map tasks.
    * Shuffle partitions: 2 waves of the cluster, or more where the bytes that
      are really shuffled need it (every aggregate here combines map-side
      first, so that is far less than the input). Every map task keeps a
      status per shuffle partition, so their product is bounded here rather
      than left to AQE, which coalesces only after it has been paid for.
    * AQE skew-join splitting: a key holding a third of the rows (a hot
      customer in the ``orders`` x ``customer`` join) is split into
      advisory-size pieces instead of landing in one task.
    """
    split = 256 * 1024 * 1024
    scan = min(1 << 30, max(128 << 20, input_bytes // max(1, 4 * total_cores)))
    partitions = max(2 * total_cores, -(-shuffled_bytes // split))
    return {
        "spark.sql.files.maxPartitionBytes": str(scan),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # size coalesced partitions by bytes, not by the cluster's core count
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.localShuffleReader.enabled": "true",
        # a very large k is range-sorted instead of merged in one task
        "spark.sql.execution.topKSortFallbackThreshold": "100000",
        # streaming state (one row per group; per customer name for the
        # loyalty ranking) kept off-heap and checkpointed incrementally
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_STATE_STORE,
    }


def apply_recommended_conf(spark: SparkSession, input_bytes: int, total_cores: int) -> dict[str, str]:
    """Set :func:`recommended_conf` on the session, keeping any value given
    when the application was launched. Returns what was applied."""
    applied = {}
    launched = _explicit_keys(spark)
    for k, v in recommended_conf(input_bytes, total_cores).items():
        if k not in launched:
            spark.conf.set(k, v)
            applied[k] = v
    return applied


def _explicit_keys(spark: SparkSession) -> set[str]:
    return {k for k, _ in spark.sparkContext.getConf().getAll()}


def shared_dir_or_none(spark: SparkSession) -> str | None:
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the cluster's shared checkpoint folder
    (``spark.checkpoint.dir``). Raises if the session names none: a
    machine-local temporary folder would not survive the loss of the
    executor that wrote it."""
    base = shared_dir_or_none(spark)
    if not base:
        raise RuntimeError(
            f"{CHECKPOINT_CONF} is not set; set it to a folder every executor can reach"
        )
    return os.path.join(base, *parts) if parts else base


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut a lineage. A session on one
    machine (``local`` masters, as in tests) that names none gets a folder of
    its own; any other session without one raises, see :func:`shared_dir`."""
    if not shared_dir_or_none(spark) and spark.sparkContext.master.startswith("local"):
        own = tempfile.mkdtemp(prefix="ledgerlens-shared-")
        spark.conf.set(CHECKPOINT_CONF, own)
        spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)
