"""Batch command line: one subcommand per reference request.

The reference answered HTTP requests; here the same requests are batch
jobs over a stored table, writing their result to a sink (JSON lines by
default, or Parquet), e.g.::

    python -m ledgerlens top-loyal --table s3://.../ct --out s3://.../top \\
        --k 10 --criteria total_spent
    python -m ledgerlens forecast --table ... --out ... --months-ahead 6

Argument checks are the operators' own (``ValueError``), so a bad value
fails the job before any Spark work starts.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.operators.cashflow import cash_flow_trend, estimate_cash_flow, historical_cash_flow
from ledgerlens.operators.customers import top_loyal_customers
from ledgerlens.operators.discounts import discounts_by_age_group, discounts_by_gender, sales_by_discount
from ledgerlens.operators.geo import (
    age_group_sales_by_state,
    heatmap_legend,
    product_counts_by_state,
    sales_by_state,
    state_heatmap,
)
from ledgerlens.operators.quality import key_violations
from ledgerlens.plans.dashboard import customer_table, discount_breakdowns, map_breakdowns
from ledgerlens.sources.tables import read_transactions_csv, read_transactions_parquet, write_json


def _commands() -> dict[str, tuple[str, Callable[[SparkSession, DataFrame, argparse.Namespace], DataFrame]]]:
    return {
        "top-loyal": ("top customers by spend, frequency or both",
                      lambda s, ct, a: top_loyal_customers(ct, a.k, a.criteria)),
        "customers": ("customer table: summary, payer class, filters, sort",
                      lambda s, ct, a: customer_table(ct, a.threshold, a.age_group, a.gender, a.sort_by, not a.descending)),
        "discounts-gender": ("discounts by gender", lambda s, ct, a: discounts_by_gender(ct)),
        "discounts-age": ("discounts by age group", lambda s, ct, a: discounts_by_age_group(ct)),
        "discounts-type": ("sales by discount type", lambda s, ct, a: sales_by_discount(ct)),
        "discounts-all": ("gender and age-group breakdowns in one pass", lambda s, ct, a: discount_breakdowns(ct)),
        "cash-flow": ("monthly cash flow", lambda s, ct, a: historical_cash_flow(ct)),
        "forecast": ("linear-trend forecast", lambda s, ct, a: estimate_cash_flow(ct, a.months_ahead)),
        "trend": ("history + forecast series", lambda s, ct, a: cash_flow_trend(ct, a.months_ahead)),
        "state-age": ("sales per state and age group", lambda s, ct, a: age_group_sales_by_state(ct, a.state)),
        "state-products": ("product counts per state", lambda s, ct, a: product_counts_by_state(ct, a.state)),
        "state-sales": ("rounded sales per state", lambda s, ct, a: sales_by_state(ct)),
        "heatmap": ("heatmap position per state of --states",
                    lambda s, ct, a: state_heatmap(sales_by_state(ct), _states(s, a))),
        "legend": ("heatmap legend", lambda s, ct, a: heatmap_legend(sales_by_state(ct))),
        "maps": ("every map view for all states in one pass", lambda s, ct, a: map_breakdowns(ct)),
        "key-check": ("NULL or duplicate (cid, tid)", lambda s, ct, a: key_violations(ct)),
    }


def _states(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if not args.states:
        raise ValueError("--states (a Parquet table with a 'state' column) is required")
    return spark.read.parquet(args.states).select("state")


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerlens", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name, (help_text, _) in _commands().items():
        c = sub.add_parser(name, help=help_text)
        c.add_argument("--table", required=True, help="customer_transactions location")
        c.add_argument("--format", choices=["parquet", "csv"], default="parquet", help="table format")
        c.add_argument("--out", required=True, help="result location")
        c.add_argument("--out-format", choices=["json", "parquet"], default="json")
        c.add_argument("--mode", default="errorifexists", help="save mode of the result")
        if name == "top-loyal":
            c.add_argument("--k", type=int, default=10)
            c.add_argument("--criteria", default="total_spent")
        if name == "customers":
            c.add_argument("--threshold", default="15")
            c.add_argument("--age-group", default="")
            c.add_argument("--gender", default="")
            c.add_argument("--sort-by", default="client_name")
            c.add_argument("--descending", action="store_true")
        if name in ("forecast", "trend"):
            c.add_argument("--months-ahead", type=int, default=6)
        if name in ("state-age", "state-products"):
            c.add_argument("--state", default=None, help="one state; all states when omitted")
        if name == "heatmap":
            c.add_argument("--states", default=None)
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Parse ``argv``, run the command, write its result; returns the
    result DataFrame (already written)."""
    args = build_parser().parse_args(argv)
    read = read_transactions_parquet if args.format == "parquet" else read_transactions_csv
    ct = read(spark, args.table)
    result = _commands()[args.command][1](spark, ct, args)
    if args.out_format == "json":
        write_json(result, args.out, args.mode)
    else:
        result.write.mode(args.mode).parquet(args.out)
    return result


def main(argv: list[str] | None = None) -> None:
    import sys

    argv = sys.argv[1:] if argv is None else argv
    build_parser().parse_args(argv)  # --help and bad arguments exit before a JVM starts
    spark = SparkSession.builder.appName("ledgerlens").getOrCreate()
    run(spark, argv)


if __name__ == "__main__":
    main()
