"""Helpers shared by the operators of this subpackage: tables written to the
shared folder, fresh column names, sizing, whole-partition Arrow functions."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_dir


def shared_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session on one
    machine (a local test session) that names none gets a folder of its own;
    any other raises."""
    base = scratch_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared
    folder: they survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        #: session settings while a table is made
        self.settings: dict[str, str] = {}

    def write(self, df: DataFrame, batch_rows: int | None = None, partition_by: str | None = None) -> DataFrame:
        """``batch_rows`` bounds the Arrow batches of wide rows while this table
        is made; ``partition_by`` gives a folder per value of a column of few values."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", self.spark.conf
        settings = self.settings | ({name: str(min(int(conf.get(name)), batch_rows))} if batch_rows else {})
        before = {k: conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            df.write.parquet(path, partitionBy=partition_by)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        # without a row there is no folder to read the columns from
        out = (self.spark.read.schema(df.schema) if partition_by else self.spark.read).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(amount: int, each: int, least: int = 8) -> int:
    """Tasks for ``amount`` units of work at ``each`` units a task."""
    return max(least, -(-amount // each))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def whole_partition(fn: Callable[[pa.Table], pa.Table], schema: pa.Schema):
    """A ``mapInArrow`` function that hands ``fn`` a partition at once. Use it
    only behind a repartition by key whose partition number follows the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what the worker's last task left in cycles
        kept = [b for b in batches if b.num_rows]
        if kept:
            table = pa.Table.from_batches(kept)
            kept.clear()
            out = fn(table)
            yield from out.cast(schema).to_batches(max_chunksize=20_000)

    return run
