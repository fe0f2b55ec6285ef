"""Table-contract checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.schema import CT_KEY


def key_violations(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that break a NOT NULL primary key.

    Returns one row per offending key value: the key columns, ``n_rows``
    (how many rows carry it) and ``violation`` — ``null_key`` when any key
    column is NULL, else ``duplicate_key`` (``n_rows > 1``). An empty
    result means the contract holds.

    One grouped count: partial counts per map task, then one shuffle of
    at most (tasks x distinct keys) rows, so a key repeated a billion
    times costs no more than one repeated twice.
    """
    keys = list(keys or CT_KEY)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.filter(any_null | (F.col("n_rows") > 1)).select(
        *keys,
        "n_rows",
        F.when(any_null, F.lit("null_key")).otherwise(F.lit("duplicate_key")).alias("violation"),
    )
