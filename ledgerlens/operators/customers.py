"""Customer-level operators: loyalty ranking, per-customer summary,
payer classification, and the summary table's filter and sort."""

from __future__ import annotations

import re
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.columns import (
    MICROS_PER_DAY,
    asc_sql,
    delay_micros,
    desc_sql,
    money_sum,
    money_total,
)

# The loyalty criteria the reference accepts (anything else
# means "combined") and its payer-class labels.
LOYALTY_CRITERIA = ("total_spent", "purchase_frequency", "combined")
LATE, PROMPT = "late", "prompt"


def _check_k(k) -> int:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k must be an int, got {type(k).__name__}")
    if k < 0:
        raise ValueError(f"k must be >= 0, got {k}")
    return k


def loyalty_criterion(criteria: str | None) -> str:
    """Case-insensitive criterion; anything unknown means ``combined``."""
    c = (criteria or "").lower()
    return c if c in LOYALTY_CRITERIA else "combined"


def top_loyal_customers(df: DataFrame, k: int, criteria: str = "combined") -> DataFrame:
    """Top ``k`` customer names by spend, purchase count, or both.

    Groups by ``client_name`` (two customers with one name merge; NULL is
    one group). ``loyalty_score`` is the spend, the count, or their sum.
    Ties at the cut are broken by name, NULLs last.

    Plan: partial aggregate on each map task, one shuffle on
    ``client_name``, final aggregate, then ``TakeOrderedAndProject`` — each
    task keeps only its own top ``k`` before the single merge.
    """
    k = _check_k(k)
    crit = loyalty_criterion(criteria)
    grouped = df.groupBy("client_name").agg(
        F.count("tid").alias("purchase_frequency"),
        money_sum("net_amount").alias("total_spent"),
    )
    if crit == "total_spent":
        score = F.col("total_spent")
    elif crit == "purchase_frequency":
        score = F.col("purchase_frequency")
    else:
        score = F.col("total_spent") + F.col("purchase_frequency")
    ranked = grouped.select(
        "client_name",
        "purchase_frequency",
        "total_spent",
        score.alias("loyalty_score"),
    )
    order_key = "loyalty_score" if crit == "combined" else crit
    return ranked.orderBy(desc_sql(order_key), asc_sql("client_name")).limit(k)


def customer_summary(df: DataFrame) -> DataFrame:
    """One row per distinct ``(cid, client_name, age_group, gender)``.

    Each row carries the totals of **all** the customer's transactions
    (keyed by ``cid``), so a customer with two profiles yields two rows
    with the same totals. ``cid`` itself is not an output column.

    ``avg_payment_delay`` is the mean of ``pay_date - purchase_date`` in
    fractional days over rows where both dates are set; it may be negative
    and is NULL when no row has both.

    The final sort is by name and then by ``cid`` (dropped afterwards): the
    reference leaves ties open, and the second key lets the range partitioner
    split a name shared by very many customers (or the NULL name) across tasks
    instead of sorting it in one. See :func:`summary_rows` for the plan.
    """
    return summary_rows(df).orderBy(asc_sql("client_name"), asc_sql("cid")).drop("cid")


def summary_rows(df: DataFrame) -> DataFrame:
    """The rows of :func:`customer_summary` with their ``cid``, in no order.

    Plan: the table is scanned and aggregated once, per profile; the totals of
    a ``cid`` are sums over its profiles, and are joined back to them. Both
    sides of the join come from one exchange, which is reused. Both carry a
    second, derived key, so both are shuffled for the join and AQE can split a
    ``cid`` with very many profiles (a guest or sentinel customer); a window
    per ``cid``, or a join that reuses the totals' partitioning, would keep it
    in one task.

    Two things keep the exchange the same on both sides. The profile columns
    come out of a generator, so a later filter on them stays above it instead
    of reaching the scan of one side. And every measure is used on both sides:
    the profile's own one where there were no total, which does not occur.
    """
    delay = delay_micros("pay_date", "purchase_date")
    # The reference's equi-join on cid never matches a NULL cid, so such
    # rows (a broken key, see key_violations) yield no summary row.
    profiles = (
        df.filter(F.col("cid").isNotNull())
        .groupBy("cid", "client_name", "age_group", "gender")
        .agg(
            F.count("tid").alias("n"),
            money_sum("net_amount").alias("spent"),
            F.sum(delay).alias("delay"),
            F.count(delay).alias("delays"),
        )
    )
    totals = profiles.groupBy(F.col("cid").alias("_cid")).agg(
        F.sum("n").alias("_n"),
        money_total("spent").alias("_spent"),
        F.sum(F.col("delay").cast("decimal(38,0)")).alias("_delay"),
        F.sum("delays").alias("_delays"),
    )
    totals = totals.withColumn("_cid_key", F.xxhash64("_cid"))
    profile = F.explode(F.array(F.struct("client_name", "age_group", "gender"))).alias("profile")
    rows = profiles.select("cid", F.xxhash64("cid").alias("_key"), "n", "spent", "delay", "delays", profile)
    joined = rows.join(totals, (F.col("cid") == F.col("_cid")) & (F.col("_key") == F.col("_cid_key")))
    n, spent, total_delay, delays = (F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("n", "spent", "delay", "delays"))
    return joined.select(
        "cid",
        "profile.client_name",
        "profile.age_group",
        "profile.gender",
        n.alias("purchase_frequency"),
        spent.alias("total_spent"),
        F.when(delays > 0, total_delay.cast("double") / delays / F.lit(float(MICROS_PER_DAY))).alias("avg_payment_delay"),
    )


_LEADING_INT = re.compile(r"^\s*([+-]?\d+)")


def parse_threshold(value) -> float:
    """Threshold as the page reads it: a number, or the leading integer of
    a text; anything else is 0."""
    if value is None or isinstance(value, bool):
        return 0.0
    if isinstance(value, Real):
        return float(value)
    m = _LEADING_INT.match(str(value))
    return float(m.group(1)) if m else 0.0


def classify_payers(summary: DataFrame, threshold_days=15) -> DataFrame:
    """Add ``payer_class``: ``late`` when the mean delay is strictly above
    the threshold, else ``prompt``.

    A NULL delay compares as 0, as the page's comparison coerced it: it is
    ``prompt`` for any threshold >= 0 and ``late`` for a negative one.
    """
    t = parse_threshold(threshold_days)
    delay = F.coalesce(F.col("avg_payment_delay"), F.lit(0.0))
    return summary.withColumn(
        "payer_class",
        F.when(delay > F.lit(t), F.lit(LATE)).otherwise(F.lit(PROMPT)),
    )


def filter_customers(summary: DataFrame, age_group: str | None = "", gender: str | None = "") -> DataFrame:
    """Exact, case-sensitive match on age group and gender; an empty or
    missing value means no filter on that column. Both are AND-ed."""
    out = summary
    if age_group:
        out = out.filter(F.col("age_group") == F.lit(age_group))
    if gender:
        out = out.filter(F.col("gender") == F.lit(gender))
    return out


SORTABLE_COLUMNS = (
    "client_name",
    "age_group",
    "gender",
    "purchase_frequency",
    "total_spent",
    "avg_payment_delay",
)


def sort_customers(summary: DataFrame, column: str = "client_name", ascending: bool = True) -> DataFrame:
    """Order the summary by one column (numbers numerically), NULLs last on
    ascending and first on descending; ties by name, age group, gender.

    The last key is a hash of the whole row: deterministic, invisible in
    the output, and it lets the range partitioner of the global sort split
    a tie group that holds a large share of the rows (say NULL totals with
    NULL names) instead of sorting it in one task.
    """
    if column not in SORTABLE_COLUMNS:
        raise ValueError(f"cannot sort by {column!r}; choose one of {SORTABLE_COLUMNS}")
    first = asc_sql(column) if ascending else desc_sql(column)
    ties = [asc_sql(c) for c in ("client_name", "age_group", "gender") if c != column]
    row_hash = F.xxhash64(*[F.col(c) for c in summary.columns])
    return summary.orderBy(first, *ties, row_hash)
