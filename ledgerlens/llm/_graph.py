"""Connected components as Spark jobs (alternating large-star / small-star,
Kiveris et al. 2014). Nothing but one scalar per round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._shared import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): every vertex u with the least v of its edges."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the least neighbour of u. Both join sides get
    an exchange of their own (the aggregate is re-keyed by a derived column),
    so adaptive execution can split a hub that holds most edges."""
    least = least.select(F.col("u").alias("u2"), "m", F.xxhash64("u").alias("k2"))
    return edges.withColumn("k", F.xxhash64("u")).join(least, (F.col("u") == F.col("u2")) & (F.col("k") == F.col("k2"))).select("u", "v", "m")


def _unsettled(e: DataFrame) -> int:
    """Vertices that hang on two others, or on one and hold some themselves:
    without any, the edges are stars around the least vertices. One aggregation
    tells, where a further round would have to show that nothing changes."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR up = 1 AND down = 1").count()


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: bigint) -> (v, component): every vertex that has an
    edge and the least vertex reachable from it. NULL ends and loops are
    ignored; an empty edge table gives an empty result."""
    a, b = edges.columns[:2]
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    e = scratch.write(e)
    for _ in range(max_rounds):
        if not _unsettled(e):
            break
        # large star: every larger neighbour hangs on the least one
        back = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        big = _beside(back, _least_neighbour(e.union(back))).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        big = scratch.write(big)
        # small star: smaller neighbours hang on the least one
        least = _least_neighbour(big)
        small = _beside(big, least).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e, big)
        e = new
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v").alias("component")).distinct()
    )
