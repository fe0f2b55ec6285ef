"""Hand-made edge rows (FIXTURES.md §3): the semantics the fixture view
does not plant."""

import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens import (
    cash_flow_trend,
    classify_payers,
    customer_summary,
    estimate_cash_flow,
    filter_customers,
    historical_cash_flow,
    heatmap_legend,
    key_violations,
    product_counts_by_state,
    age_group_sales_by_state,
    sales_by_state,
    sort_customers,
    state_heatmap,
    top_loyal_customers,
)

D = Decimal


def ts(*a):
    return datetime(*a)


# ---------------------------------------------------------------- loyalty


def test_null_client_name_is_one_group_and_sorts_last_on_ties(make_ct):
    ct = make_ct(
        [
            {"client_name": None, "net_amount": D("5.00")},
            {"client_name": None, "net_amount": D("5.00")},
            {"client_name": "b", "net_amount": D("10.00")},
            {"client_name": "a", "net_amount": D("10.00")},
        ]
    )
    rows = top_loyal_customers(ct, 10, "total_spent").collect()
    assert [r.client_name for r in rows] == ["a", "b", None]
    assert rows[2].purchase_frequency == 2


def test_all_null_amounts_sort_first_on_desc(make_ct):
    ct = make_ct(
        [
            {"client_name": "x", "net_amount": None},
            {"client_name": "y", "net_amount": D("100.00")},
        ]
    )
    rows = top_loyal_customers(ct, 10, "total_spent").collect()
    assert rows[0].client_name == "x" and rows[0].total_spent is None


def test_criteria_case_insensitive_and_unknown_is_combined(make_ct):
    ct = make_ct(
        [
            {"client_name": "many", "net_amount": D("1.00")},
            {"client_name": "many", "net_amount": D("1.00")},
            {"client_name": "many", "net_amount": D("1.00")},
            {"client_name": "rich", "net_amount": D("2.50")},
        ]
    )
    by_spent = top_loyal_customers(ct, 1, "TOTAL_SPENT").collect()
    assert by_spent[0].client_name == "many"  # 3.00 > 2.50
    by_freq = top_loyal_customers(ct, 1, "Purchase_Frequency").collect()
    assert by_freq[0].client_name == "many" and by_freq[0].loyalty_score == 3
    combined = top_loyal_customers(ct, 2, "whatever").collect()
    assert [r.loyalty_score for r in combined] == [D("6.00"), D("3.50")]
    assert top_loyal_customers(ct, 2, None).collect() == combined


def test_k_zero_empty_and_negative_raises(make_ct):
    ct = make_ct([{"client_name": "a", "net_amount": D("1.00")}])
    assert top_loyal_customers(ct, 0, "total_spent").count() == 0
    with pytest.raises(ValueError):
        top_loyal_customers(ct, -1, "total_spent")


# ---------------------------------------------------------------- summary


def test_negative_delay_and_all_null_pay_dates(make_ct):
    ct = make_ct(
        [
            {"cid": 1, "client_name": "early", "purchase_date": ts(2020, 1, 2), "pay_date": ts(2020, 1, 1, 12)},
            {"cid": 2, "tid": 10, "client_name": "unpaid", "purchase_date": ts(2020, 1, 1)},
            {"cid": 2, "tid": 11, "client_name": "unpaid", "purchase_date": ts(2020, 2, 1)},
        ]
    )
    rows = {r.client_name: r for r in classify_payers(customer_summary(ct), 15).collect()}
    assert rows["early"].avg_payment_delay == -0.5
    assert rows["unpaid"].avg_payment_delay is None
    assert rows["unpaid"].payer_class == "prompt"
    assert rows["unpaid"].purchase_frequency == 2
    # a NULL delay compares as 0: late only for a negative threshold
    neg = {r.client_name: r.payer_class for r in classify_payers(customer_summary(ct), "-1").collect()}
    assert neg["unpaid"] == "late" and neg["early"] == "late"  # -0.5 > -1


def test_delay_exactly_at_threshold_is_prompt(make_ct):
    ct = make_ct([{"client_name": "t", "purchase_date": ts(2020, 1, 1), "pay_date": ts(2020, 1, 16)}])
    row = classify_payers(customer_summary(ct), 15).first()
    assert row.avg_payment_delay == 15.0 and row.payer_class == "prompt"
    assert classify_payers(customer_summary(ct), 14).first().payer_class == "late"
    # text thresholds parse like the page: leading integer, else 0
    assert classify_payers(customer_summary(ct), "14.9").first().payer_class == "late"
    assert classify_payers(customer_summary(ct), "abc").first().payer_class == "late"


def test_profile_fan_out_carries_customer_totals(make_ct):
    ct = make_ct(
        [
            {"cid": 7, "tid": 1, "client_name": "n", "age_group": "18-25", "net_amount": D("1.00")},
            {"cid": 7, "tid": 2, "client_name": "n", "age_group": "25-45", "net_amount": D("2.00")},
            {"cid": 7, "tid": 3, "client_name": "n", "age_group": "25-45", "net_amount": D("4.00")},
        ]
    )
    rows = customer_summary(ct).collect()
    assert len(rows) == 2
    assert {r.purchase_frequency for r in rows} == {3}
    assert {r.total_spent for r in rows} == {D("7.00")}


def test_null_cid_rows_yield_no_summary_row(spark):
    from ledgerlens.schema import CT_SCHEMA, CT_COLUMNS

    nullable = CT_SCHEMA.fromJson(CT_SCHEMA.jsonValue())
    for f in nullable.fields:
        f.nullable = True
    row = {c: None for c in CT_COLUMNS}
    rows = [dict(row, cid=None, tid=1, client_name="ghost"), dict(row, cid=5, tid=2, client_name="real")]
    ct = spark.createDataFrame([tuple(r[c] for c in CT_COLUMNS) for r in rows], nullable)
    assert [r.client_name for r in customer_summary(ct).collect()] == ["real"]


def test_delay_is_exact_across_dst_change(spark, make_ct):
    # Brazil moved clocks forward at 2017-10-15 00:00 local time.
    ct = make_ct(
        [{"client_name": "d", "purchase_date": ts(2017, 10, 14, 12), "pay_date": ts(2017, 10, 16, 12, 0, 0, 250000)}]
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        dst = customer_summary(ct).first().avg_payment_delay
        months = [r.month for r in historical_cash_flow(ct).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert dst == (2 * 86400 + 0.25) / 86400
    assert months == [ts(2017, 10, 1)]


def test_filter_and_sort(make_ct):
    ct = make_ct(
        [
            {"cid": 1, "client_name": "a", "age_group": "18-25", "gender": "Male", "net_amount": D("9.00")},
            {"cid": 2, "client_name": "b", "age_group": "18-25", "gender": "Female", "net_amount": D("10.00")},
            {"cid": 3, "client_name": "c", "age_group": "25-45", "gender": "Male", "net_amount": None},
        ]
    )
    s = customer_summary(ct)
    assert {r.client_name for r in filter_customers(s, "18-25", "").collect()} == {"a", "b"}
    assert {r.client_name for r in filter_customers(s, "18-25", "Male").collect()} == {"a"}
    assert filter_customers(s, "", "").count() == 3
    assert filter_customers(s, "18-25", "male").count() == 0
    desc = [r.client_name for r in sort_customers(s, "total_spent", False).collect()]
    assert desc == ["c", "b", "a"]  # NULL first on descending, numeric order
    asc = [r.client_name for r in sort_customers(s, "total_spent", True).collect()]
    assert asc == ["a", "b", "c"]  # NULL last on ascending
    with pytest.raises(ValueError):
        sort_customers(s, "cid")


# ---------------------------------------------------------------- cash flow


def test_month_gaps_are_not_filled_and_null_month_is_last(make_ct):
    ct = make_ct(
        [
            {"purchase_date": ts(2020, 1, 5), "net_amount": D("10.00")},
            {"purchase_date": ts(2020, 5, 5), "net_amount": D("20.00")},
            {"purchase_date": ts(2020, 9, 5), "net_amount": D("30.00")},
            {"purchase_date": None, "net_amount": D("1.00")},
        ]
    )
    rows = historical_cash_flow(ct).collect()
    assert [r.month for r in rows] == [ts(2020, 1, 1), ts(2020, 5, 1), ts(2020, 9, 1), None]
    trend = cash_flow_trend(ct, 1).collect()
    assert [r.month_no for r in trend] == [1, 2, 3, 4, 5]
    assert [r.label for r in trend] == ["Month 1", "Month 2", "Month 3", "Month 4", "Month 5"]
    assert [r.kind for r in trend] == ["historical"] * 4 + ["forecast"]


def test_linear_history_predicts_at_n_plus_m(make_ct):
    ct = make_ct(
        [
            {"purchase_date": ts(2020, 1, 1), "net_amount": D("10.00")},
            {"purchase_date": ts(2020, 2, 1), "net_amount": D("20.00")},
            {"purchase_date": ts(2020, 3, 1), "net_amount": D("30.00")},
        ]
    )
    rows = estimate_cash_flow(ct, 2).collect()
    assert [(r.month_ahead, round(r.predicted_cash_flow, 9)) for r in rows] == [(1, 50.0), (2, 60.0)]


@pytest.mark.parametrize("n_months", [0, 1])
def test_too_little_history_gives_nan(make_ct, n_months):
    rows = [{"purchase_date": ts(2020, 1, 1), "net_amount": D("10.00")}] * n_months
    ct = make_ct(rows)
    preds = [r.predicted_cash_flow for r in estimate_cash_flow(ct, 3).collect()]
    assert len(preds) == 3 and all(math.isnan(p) for p in preds)


def test_months_ahead_bounds(make_ct):
    ct = make_ct([{"purchase_date": ts(2020, 1, 1), "net_amount": D("10.00")}])
    with pytest.raises(ValueError):
        estimate_cash_flow(ct, -1)
    with pytest.raises(ValueError):
        estimate_cash_flow(ct, 13)
    assert estimate_cash_flow(ct, 0).count() == 0
    assert estimate_cash_flow(ct, 12).count() == 12
    assert cash_flow_trend(ct, 0).count() == 1


# ---------------------------------------------------------------- maps


def test_round_half_away_from_zero(make_ct):
    ct = make_ct(
        [
            {"purchaselocation": "P", "net_amount": D("2.50")},
            {"purchaselocation": "N", "net_amount": D("-2.50")},
        ]
    )
    got = {r.state: r.total_sales for r in sales_by_state(ct).collect()}
    assert got == {"P": D("3"), "N": D("-3")}


def test_heatmap_missing_state_and_flat_scale(spark, make_ct):
    ct = make_ct(
        [
            {"purchaselocation": "A", "net_amount": D("10.00")},
            {"purchaselocation": "B", "net_amount": D("30.00")},
        ]
    )
    states = spark.createDataFrame([("A",), ("B",), ("C",), ("a",)], "state string")
    got = {r.state: (r.total_sales, r.intensity) for r in state_heatmap(sales_by_state(ct), states).collect()}
    assert got["A"] == (D("10"), 0.0)
    assert got["B"] == (D("30"), 1.0)
    assert got["C"] == (D("0"), -0.5)  # below the minimum: not clamped
    assert got["a"] == (D("0"), -0.5)  # case-sensitive: no match
    flat = make_ct(
        [
            {"purchaselocation": "A", "net_amount": D("10.00")},
            {"purchaselocation": "B", "net_amount": D("10.00")},
        ]
    )
    got = {r.state: r.intensity for r in state_heatmap(sales_by_state(flat), states).collect()}
    assert got["A"] == 0.5 and got["B"] == 0.5
    legend = heatmap_legend(sales_by_state(ct)).first()
    assert (legend.min_sales, legend.mid_sales, legend.max_sales) == (10.0, 20.0, 30.0)


def test_state_filter_is_exact(make_ct):
    ct = make_ct(
        [
            {"purchaselocation": "Texas", "age_group": "18-25", "product_category": None, "net_amount": D("1.00")},
            {"purchaselocation": "texas", "age_group": "18-25", "product_category": "X", "net_amount": D("2.00")},
        ]
    )
    rows = age_group_sales_by_state(ct, "Texas").collect()
    assert [(r.state, r.total_sales) for r in rows] == [("Texas", D("1.00"))]
    counts = product_counts_by_state(ct, "Texas").collect()
    assert [(r.produs, r.produstotal) for r in counts] == [(None, 0)]


# ---------------------------------------------------------------- contract


def test_key_violations(make_ct):
    ct = make_ct(
        [
            {"cid": 1, "tid": 1},
            {"cid": 1, "tid": 1},
            {"cid": 2, "tid": 2},
        ]
    )
    rows = key_violations(ct).collect()
    assert [(r.cid, r.tid, r.n_rows, r.violation) for r in rows] == [(1, 1, 2, "duplicate_key")]


def test_key_violations_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (3, 3)], "cid bigint, tid bigint")
    rows = key_violations(df).collect()
    assert [(r.cid, r.tid, r.n_rows, r.violation) for r in rows] == [(None, 1, 2, "null_key")]


# ---------------------------------------------------------------- money and regression


def test_money_sum_is_exact_past_ten_to_the_eighteen(spark):
    """Signs, cents and NULLs; a sum beyond a bigint of cents; sums of sums."""
    from ledgerlens.functions import money_sum, money_total

    amounts = [D("0.01"), D("-0.01"), D("99999999.99"), D("-99999999.99"), None, D("-0.07"), D("10485.75"), D("-10485.77")]
    df = spark.createDataFrame([(i % 2, a) for i, a in enumerate(amounts * 3)], "k int, m decimal(10,2)")
    got = {r.k: r.s for r in df.groupBy("k").agg(money_sum("m").alias("s")).collect()}
    assert got == {k: 3 * sum(a for a in amounts[k::2] if a is not None) for k in (0, 1)}
    assert df.agg(money_sum("m").alias("s")).schema["s"].dataType.simpleString() == "decimal(38,2)"
    assert spark.range(3).agg(money_sum(F.lit(None).cast("decimal(10,2)")).alias("s")).first().s is None
    most = F.lit(D("9999999999.99"))
    n = 120_000_000
    for sign in (1, -1):
        row = spark.range(n).agg(money_sum(most * F.lit(sign)).alias("s")).first()
        assert row.s == sign * n * D("9999999999.99") and abs(row.s) > 10**18
    great = D("1" + "0" * 33 + ".01")
    parts = spark.createDataFrame([(D(10) ** 33,), (D("0.01"),), (None,)], "p decimal(38,2)")
    assert parts.agg(money_total("p").alias("s")).first().s == great


def test_regression_keeps_its_digits_for_great_totals(make_ct, spark):
    """Monthly totals near 1e15 that differ in their last digits: sums of
    squares of doubles would lose the slope, centred moments keep it."""
    from fractions import Fraction

    from ledgerlens.operators.cashflow import _forecast

    totals = [D("999999999999000.00") + D(k * k % 7) + D(3 * k) for k in range(120)]
    months = spark.createDataFrame(list(enumerate(totals)), "month_index int, total_cash_flow decimal(38,2)")
    got = [r.predicted_cash_flow for r in _forecast(months.repartition(7), 12).orderBy("month_ahead").collect()]
    y, n = [Fraction(t) for t in totals], len(totals)
    mx, my = Fraction(n - 1, 2), sum(y) / n
    slope = sum((x - mx) * (v - my) for x, v in enumerate(y)) / sum((x - mx) ** 2 for x in range(n))
    want = [float(my + slope * (n + m - mx)) for m in range(1, 13)]
    assert all(abs(g - w) < 1 for g, w in zip(got, want, strict=True))
    rise = (got[-1] - got[0]) / 11
    assert abs(rise - float(slope)) < 0.05


def test_heatmap_position_is_not_rounded(spark):
    sales = spark.createDataFrame([("a", D(0)), ("b", D(1)), ("c", D(3))], "state string, total_sales decimal(38,0)")
    states = sales.select("state")
    assert {r.state: r.intensity for r in state_heatmap(sales, states).collect()} == {"a": 0.0, "b": 1 / 3, "c": 1.0}
