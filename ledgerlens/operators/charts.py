"""Chart projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chart_series(df: DataFrame, label_col: str, value_col: str) -> DataFrame:
    """``(label, value)`` pairs of a result, as a chart plots them.

    The label is rendered as text (NULL stays NULL), the value as double.
    Pure projection: Catalyst prunes every other column down to the scan.
    """
    return df.select(
        F.col(label_col).cast("string").alias("label"),
        F.col(value_col).cast("double").alias("value"),
    )
