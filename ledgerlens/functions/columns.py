"""Reusable Column expressions.

All helpers return plain Catalyst expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Fixed value: the prefix of the trend chart's month labels.
MONTH_LABEL_PREFIX = "Month "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# SQL-style NULL placement: NULLs last on ascending, first on descending.
# Spark's own defaults are the opposite on both, so every sort in the
# library goes through these two helpers.
def asc_sql(c) -> Column:
    return _col(c).asc_nulls_last()


def desc_sql(c) -> Column:
    return _col(c).desc_nulls_first()


# Cents are summed as two whole numbers, of the bits above and below this one.
_LOW_BITS = 20


def money_sum(c) -> Column:
    """``SUM`` of a money column of up to ``decimal(12,2)``: exact,
    ``decimal(38,2)``.

    Rows and partial sums are two bigints (the cents' high and low bits), so
    aggregation stays in long arithmetic, and is widened once per group at the
    end. Each half has room for 2^43 rows of the greatest amount in a group.
    """
    cents = (_col(c).cast("decimal(12,2)") * F.lit(100)).cast("bigint")
    high = F.sum(F.shiftright(cents, _LOW_BITS)).cast("decimal(20,0)")
    low = F.sum(cents.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(20,0)")
    total = high * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low
    return (total * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)")


def money_total(c) -> Column:
    """``SUM`` of money sums: partial results of :func:`money_sum`."""
    return F.sum(_col(c).cast("decimal(38,2)"))


def sum_if_true(flag, value) -> Column:
    """``SUM(CASE WHEN flag THEN value ELSE 0 END)``; NULL flag counts as false."""
    return money_sum(F.when(_col(flag), _col(value)).otherwise(F.lit(0)))


def count_true(flag) -> Column:
    """``SUM(CASE WHEN flag THEN 1 ELSE 0 END)`` as bigint."""
    return F.sum(F.when(_col(flag), F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def exact_mean(c) -> Column:
    """Mean as ``double(exact sum) / count``.

    Spark's ``avg`` on decimals rounds to a fixed scale first; summing
    exactly and dividing once keeps the full double precision.
    """
    return F.sum(_col(c)).cast("double") / F.count(_col(c))


def delay_micros(later, earlier) -> Column:
    """``later - earlier`` in whole microseconds as ``decimal(20,0)``, NULL
    if either is NULL.

    Both inputs are ``timestamp_ntz``; their difference is a day-time
    interval, which carries no zone, so a DST change in the session zone
    cannot shorten or lengthen a day. The result is a decimal, not a
    bigint, so that summing it over a customer with billions of rows
    cannot overflow.
    """
    seconds = (_col(later) - _col(earlier)).cast("interval second")
    return (seconds.cast("decimal(20,6)") * F.lit(1_000_000)).cast("decimal(20,0)")


def month_start(ts) -> Column:
    """First instant of the calendar month of a ``timestamp_ntz``.

    ``trunc`` works on the zone-free date, so the result does not depend
    on the session time zone (``date_trunc`` would return a zoned value).
    """
    return F.trunc(F.to_date(_col(ts)), "month").cast("timestamp_ntz")


def month_label(month_no) -> Column:
    """Chart label ``Month <n>``."""
    return F.concat(F.lit(MONTH_LABEL_PREFIX), _col(month_no).cast("string"))
