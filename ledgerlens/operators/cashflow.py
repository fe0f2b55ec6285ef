"""Monthly cash flow and its linear-trend forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.columns import asc_sql, money_sum, month_label, month_start

MAX_MONTHS_AHEAD = 12


def historical_cash_flow(df: DataFrame) -> DataFrame:
    """``SUM(net_amount)`` per calendar month of ``purchase_date``.

    Only months that have rows appear (no gap filling); NULL dates form
    one NULL month, sorted last. The month is a ``timestamp_ntz`` at the
    first of the month, independent of the session time zone.
    """
    return (
        df.groupBy(month_start("purchase_date").alias("month"))
        .agg(money_sum("net_amount").alias("total_cash_flow"))
        .orderBy(asc_sql("month"))
    )


def _indexed_months(df: DataFrame) -> DataFrame:
    """Monthly totals with a 0-based index over the months present.

    The window has no partition key, but its input is the monthly
    aggregate (one row per calendar month, a few hundred at most), never
    the transactions, so the single window partition stays tiny.
    """
    monthly = df.groupBy(month_start("purchase_date").alias("month")).agg(
        money_sum("net_amount").alias("total_cash_flow")
    )
    order = Window.orderBy(asc_sql("month"))
    return monthly.select(
        "month",
        "total_cash_flow",
        (F.row_number().over(order) - 1).alias("month_index"),
    )


def _check_months_ahead(months_ahead) -> int:
    if isinstance(months_ahead, bool) or not isinstance(months_ahead, int):
        raise TypeError("months_ahead must be an int")
    if months_ahead < 0 or months_ahead > MAX_MONTHS_AHEAD:
        raise ValueError(f"months_ahead must be in 0..{MAX_MONTHS_AHEAD}, got {months_ahead}")
    return months_ahead


def _ahead_rows(months_ahead: int):
    """Array column ``[1, ..., months_ahead]`` (empty for 0)."""
    if months_ahead == 0:
        return F.array().cast("array<int>")
    return F.sequence(F.lit(1), F.lit(months_ahead))


def _forecast(indexed: DataFrame, months_ahead: int) -> DataFrame:
    """``(month_ahead, x, predicted_cash_flow)`` from the indexed months.

    Ordinary least squares of the monthly total on the month index. A
    month whose total is NULL still takes an index but is not a point.
    Predictions are at ``x = n + m`` for ``m = 1..months_ahead``, where
    ``n`` is the number of month rows — the reference's indexing, which
    never predicts ``x = n``. With fewer than two points (or no spread in
    x) the line is undefined and the prediction is NaN.

    The regression is Spark's own ``regr_slope`` and ``regr_intercept``: they
    keep means and centred second moments, which are merged between partial
    aggregates, so no large sums of squares cancel. The forecast rows come from
    exploding a short array on that single row, so there is no join at all.
    """
    y = F.col("total_cash_flow").cast("double")
    x = F.col("month_index").cast("double")
    model = indexed.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
    ahead = model.select(
        "slope", "intercept", "n", F.explode(_ahead_rows(months_ahead)).alias("month_ahead")
    )
    x_new = (F.col("n") + F.col("month_ahead")).cast("double")
    pred = F.coalesce(F.col("intercept") + F.col("slope") * x_new, F.lit(float("nan")))
    return ahead.select(
        F.col("month_ahead").cast("bigint").alias("month_ahead"),
        (F.col("n") + F.col("month_ahead")).alias("x"),
        pred.alias("predicted_cash_flow"),
    )


def estimate_cash_flow(df: DataFrame, months_ahead: int) -> DataFrame:
    """Linear-trend forecast of the monthly cash flow, ``months_ahead`` in
    0..12 (outside raises ``ValueError``; 0 gives an empty frame).

    Columns: ``month_ahead bigint``, ``predicted_cash_flow double``.
    """
    m = _check_months_ahead(months_ahead)
    return _forecast(_indexed_months(df), m).select("month_ahead", "predicted_cash_flow")


def cash_flow_trend(df: DataFrame, months_ahead: int = 6) -> DataFrame:
    """One labelled series for the trend chart: the ``n`` historical months
    as ``Month 1..n`` followed by the forecasts as ``Month n+1..n+m``.

    Columns: ``month_no bigint``, ``label``, ``kind`` (``historical`` or
    ``forecast``), ``cash_flow double``. Both halves come from one monthly
    aggregate, so Spark reuses its exchange rather than scanning twice.
    """
    m = _check_months_ahead(months_ahead)
    indexed = _indexed_months(df)
    hist = indexed.select(
        (F.col("month_index") + 1).cast("bigint").alias("month_no"),
        F.lit("historical").alias("kind"),
        F.col("total_cash_flow").cast("double").alias("cash_flow"),
    )
    fut = _forecast(indexed, m).select(
        F.col("x").cast("bigint").alias("month_no"),
        F.lit("forecast").alias("kind"),
        F.col("predicted_cash_flow").alias("cash_flow"),
    )
    return (
        hist.unionByName(fut)
        .select("month_no", month_label("month_no").alias("label"), "kind", "cash_flow")
        .orderBy(asc_sql("month_no"))
    )
