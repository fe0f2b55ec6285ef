"""

``entry(spark)`` runs the flagship query on sf0.001; ``queries()`` maps
each implemented operator to a callable ``(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` gives the equivalent DuckDB SQL for each, over the same
driver tables.

Every query reads the driver tables through the fixture view
(``orders``, ``customer``, ``nation``, ``lineitem``, ``part`` -> one transaction
per order, see ``FIXTURES.md``); the oracle inlines the same view as a
means are ``double(exact sum) / count``; forecasts are compared rounded to
cents and heatmap positions rounded to 6 places, on both sides.

Two views of the same queries: ``library_queries()`` /
``library_oracle_sql()`` keep the library's exact types, and
``queries()`` / ``oracle_sql()`` (the registered ones) expose money as
DOUBLE and months as text on both sides, so that any generic result
conversion sees identical values. ``ct_queries()`` gives the queries over
``customer_transactions`` as functions of that table (property tests).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

# The package lives next to this file; make it importable however this
# module is loaded (by path, or from another working directory).
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ledgerlens.operators.cashflow import cash_flow_trend, estimate_cash_flow, historical_cash_flow
from ledgerlens.operators.charts import chart_series
from ledgerlens.operators.customers import (
    classify_payers,
    customer_summary,
    filter_customers,
    sort_customers,
    top_loyal_customers,
)
from ledgerlens.operators.discounts import discounts_by_age_group, discounts_by_gender, sales_by_discount
from ledgerlens.operators.geo import (
    age_group_sales_by_state,
    heatmap_legend,
    product_counts_by_state,
    sales_by_state,
    state_heatmap,
)
from ledgerlens.operators.quality import key_violations
from ledgerlens.plans.dashboard import (  # noqa: E402
    age_group_revenue_chart,
    customer_table,
    discount_breakdowns,
    discount_type_chart,
    loyalty_chart,
    map_breakdowns,
    state_age_chart,
    state_product_chart,
)
from ledgerlens.plans.ordered import (  # noqa: E402
    age_group_sales_positions,
    cash_flow_trend_positions,
    customer_summary_positions,
    historical_cash_flow_positions,
    product_counts_positions,
    sales_by_discount_positions,
    sales_by_state_positions,
    sort_customers_positions,
    top_loyal_positions,
)
from ledgerlens.session import scratch_dir  # noqa: E402
from ledgerlens.sources.fixture import (  # noqa: E402
    BROKEN_KEYS_SQL,
    FIXTURE_SQL,
    broken_keys_from_tpch,
    read_table,
    states_from_tpch,
    transactions_from_tpch,
)
from ledgerlens.sources.tables import (  # noqa: E402
    read_transactions_csv,
    read_transactions_parquet,
    to_json_rows,
    write_json,
    write_transactions,
    write_transactions_csv,
)

# The training-data operators and the pipeline are an optional part.
try:
    import corpus_pipeline
    from ledgerlens.llm import queries as llm_queries
except ModuleNotFoundError as e:
    if not f"{e.name}.".startswith(("corpus_pipeline.", "ledgerlens.llm.")):
        raise
    corpus_pipeline = llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Fixed query parameters (the reference UI's defaults where it has one).
TOP_K = 10
DELAY_THRESHOLD_DAYS = 15
MONTHS_AHEAD = 6
ONE_STATE = "NATION_3"
FILTER_AGE_GROUP = "18-25"
FILTER_GENDER = "Male"


def _ct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_tpch(spark, sf_dir)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the customer summary with payer classes on sf0.001."""
    return classify_payers(customer_summary(_ct(spark, SMOKE_DIR)), DELAY_THRESHOLD_DAYS)


def _round_col(df: DataFrame, name: str, digits: int) -> DataFrame:
    return df.withColumn(name, F.round(F.col(name), digits))


# --------------------------------------------------------------------------
# Comparable result types
# --------------------------------------------------------------------------
# The library returns money as exact decimals and months as timestamp_ntz.
# Engines convert those differently when results leave them (DuckDB turns
# DECIMAL into float64 and uses microsecond timestamps in pandas; Spark
# gives Decimal objects and nanoseconds; an integer column with NULLs
# becomes float64 in one and Int64 in the other), so for the side-by-side
# check both sides expose them the same way: money (and a count that can
# be NULL) as DOUBLE — the exact value converted once, bit-identical in
# both engines — and months as text.
_AS_DOUBLE = {
    "top_loyal_total_spent": ["total_spent", "loyalty_score"],
    "top_loyal_purchase_frequency": ["total_spent"],
    "top_loyal_combined": ["total_spent", "loyalty_score"],
    "customer_summary": ["total_spent"],
    "classify_payers": ["total_spent"],
    "filter_customers": ["total_spent"],
    "sort_customers": ["total_spent"],
    "customer_table": ["total_spent"],
    "discounts_by_gender": ["total_revenue", "revenue_with_discount"],
    "discounts_by_age_group": ["total_revenue", "revenue_with_discount"],
    "discount_breakdowns": ["total_revenue", "revenue_with_discount"],
    "sales_by_discount": ["total_revenue"],
    "historical_cash_flow": ["total_cash_flow"],
    "age_group_sales_by_state": ["total_sales"],
    "age_group_sales_one_state": ["total_sales"],
    "sales_by_state": ["total_sales"],
    "state_heatmap": ["total_sales"],
    "map_breakdowns": ["total_sales", "produstotal"],  # NULL-able count: double on both sides
}
# rows with their place have the columns of the result that they number
_POSITIONS = {
    "top_loyal_total_spent_positions": "top_loyal_total_spent",
    "top_loyal_purchase_frequency_positions": "top_loyal_purchase_frequency",
    "top_loyal_combined_positions": "top_loyal_combined",
    "customer_summary_positions": "customer_summary",
    "sort_customers_positions": "sort_customers",
    "sales_by_discount_positions": "sales_by_discount",
    "historical_cash_flow_positions": "historical_cash_flow",
    "age_group_sales_positions": "age_group_sales_by_state",
    "sales_by_state_positions": "sales_by_state",
}
_AS_DOUBLE |= {p: _AS_DOUBLE[of] for p, of in _POSITIONS.items()}
_TABLE_MONEY = ["discount_amount_inr", "gross_amount", "net_amount"]
_AS_DOUBLE |= {"csv_round_trip": _TABLE_MONEY, "stored_round_trip": _TABLE_MONEY}
_AS_DOUBLE["transaction_key_violations"] = ["cid", "tid"]  # NULL-able keys
_TABLE_TEXT = ["purchase_date", "pay_date", "discount_availed"]
_AS_TEXT = {
    "historical_cash_flow": ["month"],
    "historical_cash_flow_positions": ["month"],
    "csv_round_trip": _TABLE_TEXT,
    "stored_round_trip": _TABLE_TEXT,
}


def _comparable_df(name: str, df: DataFrame) -> DataFrame:
    dbl, txt = set(_AS_DOUBLE.get(name, ())), set(_AS_TEXT.get(name, ()))
    if not dbl and not txt:
        return df
    cols = [
        F.col(c).cast("double").alias(c) if c in dbl else F.col(c).cast("string").alias(c) if c in txt else F.col(c)
        for c in df.columns
    ]
    return df.select(cols)


def _comparable_sql(name: str, sql: str) -> str:
    casts = [f"CAST({c} AS DOUBLE) AS {c}" for c in _AS_DOUBLE.get(name, ())]
    casts += [f"CAST({c} AS VARCHAR) AS {c}" for c in _AS_TEXT.get(name, ())]
    if not casts:
        return sql
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}\n) AS q"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Registered queries: those of the reference's operators and, where the
    subpackage is there, the training-data operators and their pipeline."""
    out = core_queries()
    if llm_queries:
        out |= llm_queries.queries()
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    out = core_oracle_sql()
    if llm_queries:
        out |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The reference's operators as the driver compares them (see above)."""

    def comparable(name, fn):
        return lambda spark, sf_dir: _comparable_df(name, fn(spark, sf_dir))

    return {name: comparable(name, fn) for name, fn in library_queries().items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: _comparable_sql(name, sql) for name, sql in library_oracle_sql().items()}


def ct_queries() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every registered query that reads only ``customer_transactions``,
    as a function of that table (library result types)."""
    return {
        "top_loyal_total_spent": lambda ct: top_loyal_customers(ct, TOP_K, "total_spent"),
        "top_loyal_purchase_frequency": lambda ct: top_loyal_customers(ct, TOP_K, "purchase_frequency"),
        "top_loyal_combined": lambda ct: top_loyal_customers(ct, TOP_K, "combined"),
        "customer_summary": customer_summary,
        "classify_payers": lambda ct: classify_payers(customer_summary(ct), DELAY_THRESHOLD_DAYS),
        "filter_customers": lambda ct: filter_customers(customer_summary(ct), FILTER_AGE_GROUP, FILTER_GENDER),
        "sort_customers": lambda ct: sort_customers(customer_summary(ct), "total_spent", False),
        "customer_table": lambda ct: customer_table(
            ct, DELAY_THRESHOLD_DAYS, FILTER_AGE_GROUP, "", "avg_payment_delay", False
        ),
        "discounts_by_gender": discounts_by_gender,
        "discounts_by_age_group": discounts_by_age_group,
        "discount_breakdowns": discount_breakdowns,
        "sales_by_discount": sales_by_discount,
        "historical_cash_flow": historical_cash_flow,
        "estimate_cash_flow": lambda ct: _round_col(
            estimate_cash_flow(ct, MONTHS_AHEAD), "predicted_cash_flow", 2
        ),
        "cash_flow_trend": lambda ct: _round_col(cash_flow_trend(ct, MONTHS_AHEAD), "cash_flow", 2),
        "age_group_sales_by_state": age_group_sales_by_state,
        "age_group_sales_one_state": lambda ct: age_group_sales_by_state(ct, ONE_STATE),
        "product_counts_by_state": product_counts_by_state,
        "product_counts_one_state": lambda ct: product_counts_by_state(ct, ONE_STATE),
        "sales_by_state": sales_by_state,
        "heatmap_legend": lambda ct: heatmap_legend(sales_by_state(ct)),
        "chart_series": lambda ct: chart_series(discounts_by_gender(ct), "gender", "total_revenue"),
        "loyalty_chart": lambda ct: loyalty_chart(ct, TOP_K, "total_spent"),
        "age_group_revenue_chart": age_group_revenue_chart,
        "discount_type_chart": discount_type_chart,
        "state_age_chart": lambda ct: state_age_chart(ct, ONE_STATE),
        "state_product_chart": lambda ct: state_product_chart(ct, ONE_STATE),
        "transaction_key_violations": key_violations,
        "map_breakdowns": map_breakdowns,
        "json_rows": lambda ct: to_json_rows(sales_by_state(ct)),
        "json_summary_rows": lambda ct: to_json_rows(_whole_frequency(customer_summary(ct))),
        "top_loyal_total_spent_positions": lambda ct: top_loyal_positions(ct, TOP_K, "total_spent"),
        "top_loyal_purchase_frequency_positions": lambda ct: top_loyal_positions(ct, TOP_K, "purchase_frequency"),
        "top_loyal_combined_positions": lambda ct: top_loyal_positions(ct, TOP_K, "combined"),
        "customer_summary_positions": customer_summary_positions,
        "sort_customers_positions": lambda ct: sort_customers_positions(customer_summary(ct), "total_spent", False),
        "sales_by_discount_positions": sales_by_discount_positions,
        "historical_cash_flow_positions": historical_cash_flow_positions,
        "cash_flow_trend_positions": lambda ct: _round_col(
            cash_flow_trend_positions(ct, MONTHS_AHEAD), "cash_flow", 2
        ),
        "age_group_sales_positions": age_group_sales_positions,
        "product_counts_positions": product_counts_positions,
        "sales_by_state_positions": sales_by_state_positions,
    }


def _whole_frequency(summary: DataFrame) -> DataFrame:
    """The summary's exact columns; its mean delay is written by each engine
    with its own shortest digits, so it is left to the other queries."""
    return summary.drop("avg_payment_delay")


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared one."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_file_rows(ct: DataFrame) -> DataFrame:
    """The loyalty ranking as the JSON sink writes it, read back as text."""
    path = _scratch(ct.sparkSession, "json")
    write_json(top_loyal_customers(ct, TOP_K, "combined"), path)
    return ct.sparkSession.read.text(path)


def csv_round_trip(ct: DataFrame) -> DataFrame:
    """The whole table written as CSV files and loaded from them."""
    path = _scratch(ct.sparkSession, "csv")
    write_transactions_csv(ct, path)
    return read_transactions_csv(ct.sparkSession, path)


def stored_round_trip(ct: DataFrame) -> DataFrame:
    """The whole table written in the stored layout and read from it."""
    path = _scratch(ct.sparkSession, "stored")
    write_transactions(ct, path, num_files=8)
    return read_transactions_parquet(ct.sparkSession, path)


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries with the library's own result types (exact
    decimals, timestamp_ntz months), over the driver tables."""

    def on_fixture(fn):
        return lambda spark, sf_dir: fn(_ct(spark, sf_dir))

    out = {name: on_fixture(fn) for name, fn in ct_queries().items()}
    out["state_heatmap"] = lambda spark, sf_dir: _round_col(
        state_heatmap(sales_by_state(_ct(spark, sf_dir)), states_from_tpch(spark, sf_dir)), "intensity", 6
    )
    out["transaction_key_violations"] = lambda spark, sf_dir: key_violations(broken_keys_from_tpch(spark, sf_dir))
    out["json_file_rows"] = on_fixture(json_file_rows)
    out["csv_round_trip"] = on_fixture(csv_round_trip)
    out["stored_round_trip"] = on_fixture(stored_round_trip)
    out["key_violations"] = lambda spark, sf_dir: key_violations(
        read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )
    return out


# --------------------------------------------------------------------------
# DuckDB oracle
# --------------------------------------------------------------------------

_MONEY = "DECIMAL(38,2)"


def _with(*ctes: str, body: str) -> str:
    parts = [f"ct AS ({FIXTURE_SQL})", *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _top_loyal_sql(criteria: str) -> str:
    score = {
        "total_spent": f"CAST(SUM(net_amount) AS {_MONEY})",
        "purchase_frequency": "COUNT(tid)",
        "combined": f"CAST(SUM(net_amount) + COUNT(tid) AS {_MONEY})",
    }[criteria]
    order = "loyalty_score" if criteria == "combined" else criteria
    return _with(
        body=f"""
SELECT client_name, COUNT(tid) AS purchase_frequency, CAST(SUM(net_amount) AS {_MONEY}) AS total_spent,
       {score} AS loyalty_score
FROM ct GROUP BY client_name
ORDER BY {order} DESC NULLS FIRST, client_name ASC NULLS LAST
LIMIT {TOP_K}"""
    )


# Totals of a customer once, then its distinct profiles.
_SUMMARY_CTES = (
    f"""totals AS (
SELECT cid, COUNT(tid) AS purchase_frequency, CAST(SUM(net_amount) AS {_MONEY}) AS total_spent,
       SUM(date_diff('microsecond', purchase_date, pay_date)) AS delay_us,
       COUNT(*) FILTER (WHERE purchase_date IS NOT NULL AND pay_date IS NOT NULL) AS n_delays
FROM ct WHERE cid IS NOT NULL GROUP BY cid)""",
    "profiles AS (SELECT DISTINCT cid, client_name, age_group, gender FROM ct)",
    """summary_with_cid AS (
SELECT cid, client_name, age_group, gender, purchase_frequency, total_spent,
       CASE WHEN n_delays > 0 THEN CAST(delay_us AS DOUBLE) / n_delays / 86400000000.0 END AS avg_payment_delay
FROM totals JOIN profiles USING (cid))""",
    "summary AS (SELECT * EXCLUDE (cid) FROM summary_with_cid)",
)

_PAYER_CLASS = f"CASE WHEN avg_payment_delay > {DELAY_THRESHOLD_DAYS} THEN 'late' ELSE 'prompt' END"


def _discounts_sql(key: str) -> str:
    return _with(
        body=f"""
SELECT {key}, COUNT(tid) AS total_sales, CAST(SUM(net_amount) AS {_MONEY}) AS total_revenue,
       CAST(SUM(CASE WHEN discount_availed THEN net_amount ELSE 0 END) AS {_MONEY}) AS revenue_with_discount,
       CAST(SUM(CASE WHEN discount_availed THEN 1 ELSE 0 END) AS BIGINT) AS discount_count
FROM ct GROUP BY {key}"""
    )


_MONTHLY_CTES = (
    f"mon AS (SELECT CAST(date_trunc('month', purchase_date) AS TIMESTAMP) AS month, CAST(SUM(net_amount) AS {_MONEY}) AS total FROM ct GROUP BY 1)",
    "idx AS (SELECT month, total, row_number() OVER (ORDER BY month ASC NULLS LAST) - 1 AS x FROM mon)",
    """model AS (SELECT regr_slope(CAST(total AS DOUBLE), CAST(x AS DOUBLE)) AS slope,
                     regr_intercept(CAST(total AS DOUBLE), CAST(x AS DOUBLE)) AS intercept, COUNT(*) AS n FROM idx)""",
    f"fut AS (SELECT unnest(range(1, {MONTHS_AHEAD} + 1)) AS m, slope, intercept, n FROM model)",
)
_PREDICTION = "COALESCE(intercept + slope * CAST(n + m AS DOUBLE), CAST('NaN' AS DOUBLE))"

_SALES_BY_STATE_CTE = (
    "sales AS (SELECT purchaselocation AS state, CAST(ROUND(SUM(net_amount)) AS DECIMAL(38,0)) AS total_sales "
    "FROM ct GROUP BY purchaselocation)"
)


def library_oracle_sql(source_sql: str | None = None) -> dict[str, str]:
    """DuckDB SQL with the library's result types. With ``source_sql``,
    only the queries over ``customer_transactions`` are returned, reading
    that SQL instead of the fixture view (used by the property tests)."""
    sqls = _library_oracle_sql()
    if source_sql is None:
        return sqls
    fixture = f"ct AS ({FIXTURE_SQL})"
    sqls["transaction_key_violations"] = _with(body=_KEY_VIOLATIONS)
    return {n: q.replace(fixture, f"ct AS ({source_sql})") for n, q in sqls.items() if n in ct_queries()}


def _library_oracle_sql() -> dict[str, str]:
    return {
        "top_loyal_total_spent": _top_loyal_sql("total_spent"),
        "top_loyal_purchase_frequency": _top_loyal_sql("purchase_frequency"),
        "top_loyal_combined": _top_loyal_sql("combined"),
        "customer_summary": _with(*_SUMMARY_CTES, body="SELECT * FROM summary ORDER BY client_name"),
        "classify_payers": _with(
            *_SUMMARY_CTES, body=f"SELECT *, {_PAYER_CLASS} AS payer_class FROM summary"
        ),
        "filter_customers": _with(
            *_SUMMARY_CTES,
            body=f"SELECT * FROM summary WHERE age_group = '{FILTER_AGE_GROUP}' AND gender = '{FILTER_GENDER}'",
        ),
        "sort_customers": _with(
            *_SUMMARY_CTES, body="SELECT * FROM summary ORDER BY total_spent DESC NULLS FIRST, client_name"
        ),
        "customer_table": _with(
            *_SUMMARY_CTES,
            body=f"""SELECT *, {_PAYER_CLASS} AS payer_class FROM summary
WHERE age_group = '{FILTER_AGE_GROUP}' ORDER BY avg_payment_delay DESC NULLS FIRST""",
        ),
        "discounts_by_gender": _discounts_sql("gender"),
        "discounts_by_age_group": _discounts_sql("age_group"),
        "discount_breakdowns": _with(
            body=f"""
SELECT 'gender' AS dimension, gender AS value, COUNT(tid) AS total_sales,
       CAST(SUM(net_amount) AS {_MONEY}) AS total_revenue,
       CAST(SUM(CASE WHEN discount_availed THEN net_amount ELSE 0 END) AS {_MONEY}) AS revenue_with_discount,
       CAST(SUM(CASE WHEN discount_availed THEN 1 ELSE 0 END) AS BIGINT) AS discount_count
FROM ct GROUP BY gender
UNION ALL
SELECT 'age_group', age_group, COUNT(tid), CAST(SUM(net_amount) AS {_MONEY}),
       CAST(SUM(CASE WHEN discount_availed THEN net_amount ELSE 0 END) AS {_MONEY}),
       CAST(SUM(CASE WHEN discount_availed THEN 1 ELSE 0 END) AS BIGINT)
FROM ct GROUP BY age_group"""
        ),
        "sales_by_discount": _with(
            body=f"""
SELECT discount_name, COUNT(tid) AS total_sales, CAST(SUM(net_amount) AS {_MONEY}) AS total_revenue,
       CAST(SUM(discount_amount_inr) AS DOUBLE) / COUNT(discount_amount_inr) AS average_discount_amount
FROM ct WHERE discount_availed = true GROUP BY discount_name
ORDER BY total_revenue DESC NULLS FIRST"""
        ),
        "historical_cash_flow": _with(
            body=f"""
SELECT CAST(date_trunc('month', purchase_date) AS TIMESTAMP) AS month,
       CAST(SUM(net_amount) AS {_MONEY}) AS total_cash_flow
FROM ct GROUP BY 1 ORDER BY 1 ASC NULLS LAST"""
        ),
        "estimate_cash_flow": _with(
            *_MONTHLY_CTES,
            body=f"SELECT CAST(m AS BIGINT) AS month_ahead, ROUND({_PREDICTION}, 2) AS predicted_cash_flow FROM fut ORDER BY m",
        ),
        "cash_flow_trend": _with(
            *_MONTHLY_CTES,
            body=f"""
SELECT month_no, 'Month ' || CAST(month_no AS VARCHAR) AS label, kind, ROUND(cash_flow, 2) AS cash_flow FROM (
  SELECT CAST(x + 1 AS BIGINT) AS month_no, 'historical' AS kind, CAST(total AS DOUBLE) AS cash_flow FROM idx
  UNION ALL
  SELECT CAST(n + m AS BIGINT), 'forecast', {_PREDICTION} FROM fut
) ORDER BY month_no""",
        ),
        "age_group_sales_by_state": _with(
            body=f"""
SELECT purchaselocation AS state, age_group, CAST(SUM(net_amount) AS {_MONEY}) AS total_sales
FROM ct GROUP BY purchaselocation, age_group ORDER BY state"""
        ),
        "age_group_sales_one_state": _with(
            body=f"""
SELECT purchaselocation AS state, age_group, CAST(SUM(net_amount) AS {_MONEY}) AS total_sales
FROM ct WHERE purchaselocation = '{ONE_STATE}' GROUP BY purchaselocation, age_group ORDER BY state"""
        ),
        "product_counts_by_state": _with(
            body="""
SELECT purchaselocation AS state, product_category AS produs, COUNT(product_category) AS produstotal
FROM ct GROUP BY purchaselocation, product_category ORDER BY state"""
        ),
        "product_counts_one_state": _with(
            body=f"""
SELECT purchaselocation AS state, product_category AS produs, COUNT(product_category) AS produstotal
FROM ct WHERE purchaselocation = '{ONE_STATE}' GROUP BY purchaselocation, product_category ORDER BY state"""
        ),
        "sales_by_state": _with(_SALES_BY_STATE_CTE, body="SELECT * FROM sales ORDER BY state"),
        "state_heatmap": _with(
            _SALES_BY_STATE_CTE,
            "b AS (SELECT MIN(COALESCE(total_sales, 0)) AS lo, MAX(COALESCE(total_sales, 0)) AS hi FROM sales)",
            body="""
SELECT n.n_name AS state, CAST(COALESCE(s.total_sales, 0) AS DECIMAL(38,0)) AS total_sales,
       ROUND(CASE WHEN (SELECT hi FROM b) = (SELECT lo FROM b) THEN 0.5
                  ELSE CAST(COALESCE(s.total_sales, 0) - (SELECT lo FROM b) AS DOUBLE)
                       / CAST((SELECT hi FROM b) - (SELECT lo FROM b) AS DOUBLE) END, 6) AS intensity
FROM nation n LEFT JOIN sales s ON n.n_name = s.state""",
        ),
        "heatmap_legend": _with(
            _SALES_BY_STATE_CTE,
            body="""
SELECT CAST(MIN(v) AS DOUBLE) AS min_sales, CAST(MIN(v) + MAX(v) AS DOUBLE) / 2 AS mid_sales,
       CAST(MAX(v) AS DOUBLE) AS max_sales
FROM (SELECT COALESCE(total_sales, 0) AS v FROM sales)""",
        ),
        "chart_series": _with(
            body="SELECT CAST(gender AS VARCHAR) AS label, CAST(SUM(net_amount) AS DOUBLE) AS value FROM ct GROUP BY gender"
        ),
        "loyalty_chart": _with(
            body=f"""
SELECT client_name AS label, CAST(SUM(net_amount) AS DOUBLE) AS value
FROM ct GROUP BY client_name
ORDER BY SUM(net_amount) DESC NULLS FIRST, client_name ASC NULLS LAST
LIMIT {TOP_K}"""
        ),
        "age_group_revenue_chart": _with(
            body="SELECT CAST(age_group AS VARCHAR) AS label, CAST(SUM(net_amount) AS DOUBLE) AS value FROM ct GROUP BY age_group"
        ),
        "discount_type_chart": _with(
            body="""
SELECT CAST(discount_name AS VARCHAR) AS label, CAST(SUM(net_amount) AS DOUBLE) AS value
FROM ct WHERE discount_availed = true GROUP BY discount_name"""
        ),
        "state_age_chart": _with(
            body=f"""
SELECT CAST(age_group AS VARCHAR) AS label, CAST(SUM(net_amount) AS DOUBLE) AS value
FROM ct WHERE purchaselocation = '{ONE_STATE}' GROUP BY age_group"""
        ),
        "state_product_chart": _with(
            body=f"""
SELECT CAST(product_category AS VARCHAR) AS label, CAST(COUNT(product_category) AS DOUBLE) AS value
FROM ct WHERE purchaselocation = '{ONE_STATE}' GROUP BY product_category"""
        ),
        "key_violations": """
SELECT l_orderkey, l_linenumber, COUNT(*) AS n_rows,
       CASE WHEN l_orderkey IS NULL OR l_linenumber IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS violation
FROM lineitem GROUP BY l_orderkey, l_linenumber
HAVING COUNT(*) > 1 OR l_orderkey IS NULL OR l_linenumber IS NULL""",
        "map_breakdowns": _with(
            body=f"""
SELECT 'age_group' AS view, purchaselocation AS state, age_group AS key,
       CAST(SUM(net_amount) AS {_MONEY}) AS total_sales, CAST(NULL AS BIGINT) AS produstotal
FROM ct GROUP BY purchaselocation, age_group
UNION ALL
SELECT 'product', purchaselocation, product_category, CAST(NULL AS {_MONEY}), COUNT(product_category)
FROM ct GROUP BY purchaselocation, product_category
UNION ALL
SELECT 'state', purchaselocation, CAST(NULL AS VARCHAR), CAST(SUM(net_amount) AS {_MONEY}), CAST(NULL AS BIGINT)
FROM ct GROUP BY purchaselocation"""
        ),
        "transaction_key_violations": f"""
WITH ct AS ({BROKEN_KEYS_SQL})
{_KEY_VIOLATIONS}""",
        "json_rows": _with(
            _SALES_BY_STATE_CTE,
            body="SELECT CAST(to_json({'state': state, 'total_sales': total_sales}) AS VARCHAR) AS value FROM sales",
        ),
        "json_summary_rows": _with(
            *_SUMMARY_CTES,
            body="""
SELECT CAST(to_json({'client_name': client_name, 'age_group': age_group, 'gender': gender,
                     'purchase_frequency': purchase_frequency, 'total_spent': total_spent}) AS VARCHAR) AS value FROM summary""",
        ),
        "json_file_rows": f"""
SELECT CAST(to_json({{'client_name': client_name, 'purchase_frequency': purchase_frequency, 'total_spent': total_spent,
                     'loyalty_score': loyalty_score}}) AS VARCHAR) AS value FROM ({_top_loyal_sql("combined")})""",
        "csv_round_trip": _with(body="SELECT * FROM ct"),
        "stored_round_trip": _with(body="SELECT * FROM ct"),
        **{name: _numbered_sql(*spec) for name, spec in _positions_sql().items()},
    }


_KEY_VIOLATIONS = """
SELECT cid, tid, COUNT(*) AS n_rows,
       CASE WHEN cid IS NULL OR tid IS NULL THEN 'null_key' ELSE 'duplicate_key' END AS violation
FROM ct GROUP BY cid, tid HAVING COUNT(*) > 1 OR cid IS NULL OR tid IS NULL"""


def _numbered_sql(result: str, order: str, drop: str = "") -> str:
    hidden = f" EXCLUDE ({drop})" if drop else ""
    return f"SELECT *{hidden}, row_number() OVER (ORDER BY {order}) AS position FROM ({result}\n) AS r"


def _positions_sql() -> dict[str, tuple[str, ...]]:
    """Result, order and hidden columns of every result with positions."""
    up = lambda *cols: ", ".join(f"{c} ASC NULLS LAST" for c in cols)
    down = lambda c, *cols: ", ".join([f"{c} DESC NULLS FIRST", *([up(*cols)] if cols else [])])
    summary = _with(*_SUMMARY_CTES, body="SELECT * FROM summary")
    keyed = _with(*_SUMMARY_CTES, body="SELECT * FROM summary_with_cid")
    trend = f"""
SELECT month_no, 'Month ' || CAST(month_no AS VARCHAR) AS label, kind, ROUND(cash_flow, 2) AS cash_flow FROM (
  SELECT CAST(x + 1 AS BIGINT) AS month_no, 'historical' AS kind, CAST(total AS DOUBLE) AS cash_flow FROM idx
  UNION ALL
  SELECT CAST(n + m AS BIGINT), 'forecast', {_PREDICTION} FROM fut)"""
    by_discount = f"""
SELECT discount_name, COUNT(tid) AS total_sales, CAST(SUM(net_amount) AS {_MONEY}) AS total_revenue,
       CAST(SUM(discount_amount_inr) AS DOUBLE) / COUNT(discount_amount_inr) AS average_discount_amount
FROM ct WHERE discount_availed = true GROUP BY discount_name"""
    by_month = f"""
SELECT CAST(date_trunc('month', purchase_date) AS TIMESTAMP) AS month, CAST(SUM(net_amount) AS {_MONEY}) AS total_cash_flow
FROM ct GROUP BY 1"""
    by_age = f"""
SELECT purchaselocation AS state, age_group, CAST(SUM(net_amount) AS {_MONEY}) AS total_sales
FROM ct GROUP BY purchaselocation, age_group"""
    by_product = """
SELECT purchaselocation AS state, product_category AS produs, COUNT(product_category) AS produstotal
FROM ct GROUP BY purchaselocation, product_category"""
    rest = ("client_name", "age_group", "gender", "purchase_frequency", "avg_payment_delay")
    return {
        "top_loyal_total_spent_positions": (_top_loyal_sql("total_spent"), down("total_spent", "client_name")),
        "top_loyal_purchase_frequency_positions": (
            _top_loyal_sql("purchase_frequency"), down("purchase_frequency", "client_name")
        ),
        "top_loyal_combined_positions": (_top_loyal_sql("combined"), down("loyalty_score", "client_name")),
        "customer_summary_positions": (keyed, up("client_name", "cid", "age_group", "gender"), "cid"),
        "sort_customers_positions": (summary, down("total_spent", *rest)),
        "sales_by_discount_positions": (_with(body=by_discount), down("total_revenue", "discount_name")),
        "historical_cash_flow_positions": (_with(body=by_month), up("month")),
        "cash_flow_trend_positions": (_with(*_MONTHLY_CTES, body=trend), up("month_no")),
        "age_group_sales_positions": (_with(body=by_age), up("state", "age_group")),
        "product_counts_positions": (_with(body=by_product), up("state", "produs")),
        "sales_by_state_positions": (_with(_SALES_BY_STATE_CTE, body="SELECT * FROM sales"), up("state")),
    }
