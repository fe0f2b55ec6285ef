"""Row numbers over a whole table without a single-task window.

A row's position in a global order is its index inside its sorted range plus
the number of rows in all ranges before it. Ranges come from one range
exchange; their sizes are one row per range.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import scratch_dir

# monotonically_increasing_id() holds the partition above this
# many bits of the row's index within the partition.
_INDEX_BITS = 33


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name`` (bigint, from 1): the place of each row in the
    order ``order``, as ``row_number()`` over the whole table would give it.

    The range-sorted rows are written once to the shared folder, because two
    evaluations of a range exchange may sample different bounds; sizes and
    rows are then read from that table. A range holds all rows with equal keys,
    so the order should end in a key that tells rows apart (a hash of the row
    does), or a large tie group is sorted in one task. Rows that tie in every
    key are numbered in any order.

    Shuffles: the rows once; then one row per range (at most ``partitions``),
    numbered by a window over that bounded table and joined back.
    """
    spark = df.sparkSession
    if name in df.columns:
        raise ValueError(f"column {name!r} is already there")
    taken = {c.lower() for c in df.columns}
    place = "_place"
    while place in taken:
        place += "_"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{scratch_dir(spark).rstrip('/')}/ordinals-{uuid.uuid4().hex}"
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    part = F.shiftright(place, _INDEX_BITS).cast("int")
    sizes = rows.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_range").alias("_range_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    index = F.col(place).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    numbered = rows.join(F.broadcast(starts), part == F.col("_range_of"))  # at most n rows
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + index + 1).alias(name))
