"""Column-level helpers, all built from JVM-side ``pyspark.sql.functions``."""

from ledgerlens.functions.columns import (
    asc_sql,
    desc_sql,
    money_sum,
    money_total,
    count_true,
    sum_if_true,
    exact_mean,
    delay_micros,
    MICROS_PER_DAY,
    month_start,
    month_label,
)
from ledgerlens.functions.ordinal import number_rows

__all__ = [
    "asc_sql",
    "desc_sql",
    "money_sum",
    "money_total",
    "count_true",
    "sum_if_true",
    "exact_mean",
    "delay_micros",
    "MICROS_PER_DAY",
    "month_start",
    "month_label",
    "number_rows",
]
