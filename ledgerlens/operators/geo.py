"""Sales by location, for the map views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import asc_sql, money_sum

# Output names of the per-state product view, as the
# reference's pages read them.
PRODUCT_COLUMN = "produs"
PRODUCT_COUNT_COLUMN = "produstotal"


def _at_state(df: DataFrame, state: str | None) -> DataFrame:
    """Exact, case-sensitive location filter (pushed to the scan); ``None``
    keeps every location, NULL included, so one job answers all states."""
    if state is None:
        return df
    return df.filter(F.col("purchaselocation") == F.lit(state))


def age_group_sales_by_state(df: DataFrame, state: str | None = None) -> DataFrame:
    """``SUM(net_amount)`` per (location, age group) -> ``state, age_group,
    total_sales``; ordered by state."""
    return (
        _at_state(df, state)
        .groupBy(F.col("purchaselocation").alias("state"), "age_group")
        .agg(money_sum("net_amount").alias("total_sales"))
        .orderBy(asc_sql("state"))
    )


def product_counts_by_state(df: DataFrame, state: str | None = None) -> DataFrame:
    """``COUNT(product_category)`` per (location, category) -> ``state,
    produs, produstotal``. The NULL category is a group with count 0."""
    return (
        _at_state(df, state)
        .groupBy(F.col("purchaselocation").alias("state"), F.col("product_category").alias(PRODUCT_COLUMN))
        .agg(F.count("product_category").alias(PRODUCT_COUNT_COLUMN))
        .orderBy(asc_sql("state"))
    )


def sales_by_state(df: DataFrame) -> DataFrame:
    """``ROUND(SUM(net_amount))`` per location (half away from zero) ->
    ``state, total_sales decimal(38,0)``; the NULL location is a group."""
    return (
        df.groupBy(F.col("purchaselocation").alias("state"))
        .agg(F.round(money_sum("net_amount"), 0).cast("decimal(38,0)").alias("total_sales"))
        .orderBy(asc_sql("state"))
    )


def state_heatmap(sales: DataFrame, states: DataFrame) -> DataFrame:
    """Colour position of every state of the ``states`` dimension.

    ``sales`` is the output of :func:`sales_by_state`; ``states`` has one
    string column ``state``. A state without sales gets ``total_sales``
    0. ``intensity = (v - min) / (max - min)`` where min and max run over
    **all** sales groups (NULL and unmapped locations included, a NULL
    total read as 0); the scale is not clamped, so 0 can fall below the
    minimum. When min = max the position is 0.5.

    Plan: the table is scanned **once**. The per-location aggregate is
    full-outer-joined to the dimension, so every sales group (matched,
    unmatched or NULL) and every state appears; min and max are a window
    over that joined result, whose size is bounded by the two dimensions
    (locations + states), never by the transactions. Rows that are not
    dimension states are dropped after the window. A scalar subquery for
    the bounds would scan the table a second time: Catalyst infers
    ``state IS NOT NULL`` for the join side, so the two aggregates differ
    and their exchanges cannot be reused.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    dim = states.select("state", F.lit(True).alias("_in_dim"))
    s = sales.select(F.col("state").alias("_state"), F.coalesce(F.col("total_sales"), zero).alias("_v"))
    joined = dim.join(s, F.col("state") == F.col("_state"), "full_outer")
    everything = Window.partitionBy()
    lo = F.min("_v").over(everything)
    hi = F.max("_v").over(everything)
    v = F.coalesce(F.col("_v"), zero)
    span = (hi - lo).cast("double")
    intensity = F.when(span == 0, F.lit(0.5)).otherwise((v - lo).cast("double") / span)
    return (
        joined.select("state", "_in_dim", v.alias("total_sales"), intensity.alias("intensity"))
        .filter(F.col("_in_dim"))
        .drop("_in_dim")
    )


def heatmap_legend(sales: DataFrame) -> DataFrame:
    """Legend of the heatmap: ``min_sales``, ``mid_sales`` (the midpoint),
    ``max_sales`` over all sales groups, NULL totals read as 0."""
    value = F.coalesce(F.col("total_sales"), F.lit(0).cast("decimal(38,0)"))
    bounds = sales.agg(F.min(value).alias("min_sales"), F.max(value).alias("max_sales"))
    return bounds.select(
        F.col("min_sales").cast("double").alias("min_sales"),
        ((F.col("min_sales") + F.col("max_sales")).cast("double") / 2).alias("mid_sales"),
        F.col("max_sales").cast("double").alias("max_sales"),
    )
