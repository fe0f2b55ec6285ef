"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

1. Build ``customer_transactions`` once from the driver tables (fixture
   view) and write it as Parquet into a fresh scratch folder — the
   reference also queries one stored table. Timed as ``build_transactions``.
2. Time each query over that table: one warm-up pass over all queries
   (JIT, file listing, codegen caches) so that the first queries are not
   measured in a colder JVM than the last, then per query one more
   warm-up and ``$BENCH_RUNS`` (default 5) timed runs back to back, each
   executed in full into the ``noop`` sink (every row produced, nothing
   collected). The median per query is reported. Results with positions also
   write their numbered rows, and the round trip its files, in each run.

Prints ONE JSON line: ``{"metric", "value", "unit", "queries", "sf", ...}``
where ``value`` is the sum of the per-query medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.operators.cashflow import cash_flow_trend, estimate_cash_flow, historical_cash_flow  # noqa: E402
from ledgerlens.operators.charts import chart_series  # noqa: E402
from ledgerlens.operators.customers import (  # noqa: E402
    classify_payers,
    customer_summary,
    filter_customers,
    sort_customers,
    top_loyal_customers,
)
from ledgerlens.operators.discounts import (  # noqa: E402
    discounts_by_age_group,
    discounts_by_gender,
    sales_by_discount,
)
from ledgerlens.operators.geo import (  # noqa: E402
    age_group_sales_by_state,
    heatmap_legend,
    product_counts_by_state,
    sales_by_state,
    state_heatmap,
)
from ledgerlens.operators.quality import key_violations  # noqa: E402
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
from ledgerlens.plans.ordered import customer_summary_positions, sales_by_state_positions  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.fixture import broken_keys_from_tpch, states_from_tpch, transactions_from_tpch  # noqa: E402
from ledgerlens.sources.tables import read_transactions_parquet, to_json_rows, write_transactions  # noqa: E402


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _timed_all(queries: dict, runs: int) -> tuple[dict[str, float | None], dict[str, str]]:
    """Median seconds per query; a query that fails is reported as None
    with its error, and the others still run."""
    errors: dict[str, str] = {}
    for name, fn in queries.items():  # warm-up pass over everything
        try:
            _run(fn())
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"
    out: dict[str, float | None] = {}
    for name, fn in queries.items():
        if name in errors:
            out[name] = None
            continue
        _run(fn())
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            _run(fn())
            times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 4)
    return out, errors


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    scratch = tempfile.mkdtemp(prefix="ledgerlens-bench-", dir=os.environ.get("BENCH_SCRATCH"))
    spark = local_session(
        master=f"local[{cpus}]",
        shuffle_partitions=max(cpus, 8),
        checkpoint_dir=os.path.join(scratch, "checkpoints"),
    )
    table = os.path.join(scratch, "customer_transactions")

    files = int(os.environ.get("BENCH_FILES", str(2 * cpus)))
    t0 = time.perf_counter()
    write_transactions(transactions_from_tpch(spark, sf_dir), table, num_files=files)
    build_sec = time.perf_counter() - t0

    ct = read_transactions_parquet(spark, table)
    states = states_from_tpch(spark, sf_dir)
    lineitem = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet"))

    headline = {
        "top_loyal_total_spent": lambda: top_loyal_customers(ct, 10, "total_spent"),
        "top_loyal_purchase_frequency": lambda: top_loyal_customers(ct, 10, "purchase_frequency"),
        "top_loyal_combined": lambda: top_loyal_customers(ct, 10, "combined"),
        "customer_summary": lambda: customer_summary(ct),
        "classify_payers": lambda: classify_payers(customer_summary(ct), 15),
        "customer_table": lambda: customer_table(ct, 15, "18-25", "", "avg_payment_delay", False),
        "discounts_by_gender": lambda: discounts_by_gender(ct),
        "discounts_by_age_group": lambda: discounts_by_age_group(ct),
        "discount_breakdowns": lambda: discount_breakdowns(ct),
        "sales_by_discount": lambda: sales_by_discount(ct),
        "historical_cash_flow": lambda: historical_cash_flow(ct),
        "estimate_cash_flow": lambda: estimate_cash_flow(ct, 6),
        "cash_flow_trend": lambda: cash_flow_trend(ct, 6),
        "age_group_sales_by_state": lambda: age_group_sales_by_state(ct),
        "age_group_sales_one_state": lambda: age_group_sales_by_state(ct, "NATION_3"),
        "product_counts_by_state": lambda: product_counts_by_state(ct),
        "sales_by_state": lambda: sales_by_state(ct),
        "state_heatmap": lambda: state_heatmap(sales_by_state(ct), states),
        "heatmap_legend": lambda: heatmap_legend(sales_by_state(ct)),
        "map_breakdowns": lambda: map_breakdowns(ct),
        "key_violations": lambda: key_violations(lineitem, ["l_orderkey", "l_linenumber"]),
        "filter_customers": lambda: filter_customers(customer_summary(ct), "18-25", "Male"),
        "sort_customers": lambda: sort_customers(customer_summary(ct), "total_spent", False),
        "product_counts_one_state": lambda: product_counts_by_state(ct, "NATION_3"),
        "chart_series": lambda: chart_series(discounts_by_gender(ct), "gender", "total_revenue"),
        "loyalty_chart": lambda: loyalty_chart(ct, 10, "total_spent"),
        "age_group_revenue_chart": lambda: age_group_revenue_chart(ct),
        "discount_type_chart": lambda: discount_type_chart(ct),
        "state_age_chart": lambda: state_age_chart(ct, "NATION_3"),
        "state_product_chart": lambda: state_product_chart(ct, "NATION_3"),
        "transaction_key_violations": lambda: key_violations(broken_keys_from_tpch(spark, sf_dir)),
        "json_rows": lambda: to_json_rows(sales_by_state(ct)),
        "customer_summary_positions": lambda: customer_summary_positions(ct),
        "sales_by_state_positions": lambda: sales_by_state_positions(ct),
        # end to end from the driver tables (fixture joins included)
        "customer_summary_from_tpch": lambda: customer_summary(transactions_from_tpch(spark, sf_dir)),
    }

    results, errors = _timed_all(headline, runs)
    out = {
        "metric": "sum_of_median_query_sec",
        "value": round(sum(v for v in results.values() if v is not None), 4),
        "unit": "sec",
        "queries": results,
        "sf": sf,
        "build_transactions_sec": round(build_sec, 4),
        "rows": ct.count(),
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
        "python": sys.version.split()[0],
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "table_files": files,
    }
    if errors:
        out["errors"] = errors
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
