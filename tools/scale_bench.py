"""Scale-up check: time the headline queries on tables N times larger.

The larger tables are derived from the fixture view of the driver tables
(``$SCALE_SF_DIR``, default sf0.1): copy ``k`` of every transaction gets a
new ``tid`` and is assigned to one of ``m = ceil(sqrt(N))`` copies of its
customer (new ``cid``, name suffixed with the copy number), so both the
number of customers and the transactions per customer grow. Dates,
amounts, locations and the planted NULLs are kept, so group counts of the
small dimensions (months, states, genders) stay fixed while the rows grow.

Prints one JSON line per factor: ``{"factor", "rows", "queries": {...}}``.

Usage: python tools/scale_bench.py 1 10 40
"""

from __future__ import annotations

import json
import math
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ledgerlens import (  # noqa: E402
    customer_summary,
    discounts_by_gender,
    estimate_cash_flow,
    historical_cash_flow,
    key_violations,
    sales_by_discount,
    sales_by_state,
    state_heatmap,
    top_loyal_customers,
    age_group_sales_by_state,
)
from ledgerlens.plans import customer_table, discount_breakdowns  # noqa: E402
from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources import (  # noqa: E402
    read_transactions_parquet,
    states_from_tpch,
    transactions_from_tpch,
    write_transactions,
)


def scaled(ct, n: int):
    if n == 1:
        return ct
    m = math.ceil(math.sqrt(n))
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k")
    copies = ct.select("*", k)
    cust_copy = F.col("_k") % m
    return copies.select(
        *[
            (F.col("cid") * m + cust_copy).alias("cid") if c == "cid"
            else (F.col("tid") * n + F.col("_k")).alias("tid") if c == "tid"
            else F.when(F.col("client_name").isNotNull(), F.concat("client_name", F.lit("/"), cust_copy.cast("string"))).alias("client_name") if c == "client_name"
            else F.col(c)
            for c in ct.columns
        ]
    )


def main(argv):
    sf_dir = os.environ.get("SCALE_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("SCALE_RUNS", "3"))
    factors = [int(a) for a in argv[1:]] or [1, 10]
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    scratch = tempfile.mkdtemp(prefix="ledgerlens-scale-", dir=os.environ.get("BENCH_SCRATCH"))
    spark = local_session(master=f"local[{cpus}]", shuffle_partitions=2 * cpus,
                          checkpoint_dir=os.path.join(scratch, "checkpoints"))
    base = transactions_from_tpch(spark, sf_dir)
    states = states_from_tpch(spark, sf_dir)
    for n in factors:
        path = os.path.join(scratch, f"ct_x{n}")
        write_transactions(scaled(base, n), path, num_files=max(2 * cpus, 2 * cpus * n // 10))
        ct = read_transactions_parquet(spark, path)
        qs = {
            "top_loyal_total_spent": lambda: top_loyal_customers(ct, 10, "total_spent"),
            "customer_summary": lambda: customer_summary(ct),
            "customer_table": lambda: customer_table(ct, 15, "18-25", "", "avg_payment_delay", False),
            "discounts_by_gender": lambda: discounts_by_gender(ct),
            "discount_breakdowns": lambda: discount_breakdowns(ct),
            "sales_by_discount": lambda: sales_by_discount(ct),
            "historical_cash_flow": lambda: historical_cash_flow(ct),
            "estimate_cash_flow": lambda: estimate_cash_flow(ct, 6),
            "age_group_sales_by_state": lambda: age_group_sales_by_state(ct),
            "sales_by_state": lambda: sales_by_state(ct),
            "state_heatmap": lambda: state_heatmap(sales_by_state(ct), states),
            "key_violations": lambda: key_violations(ct),
        }
        out = {}
        for name, fn in qs.items():
            fn().write.format("noop").mode("overwrite").save()
            ts = []
            for _ in range(runs):
                t0 = time.perf_counter()
                fn().write.format("noop").mode("overwrite").save()
                ts.append(time.perf_counter() - t0)
            out[name] = round(statistics.median(ts), 3)
        print(json.dumps({"factor": n, "rows": ct.count(), "queries": out, "total": round(sum(out.values()), 3)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
