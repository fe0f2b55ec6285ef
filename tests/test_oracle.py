"""Every registered query equals its DuckDB oracle on the driver tables:
same column names, same rows (order-insensitive, exact values)."""


import pytest

from conftest import SF001, SF01

import __spark_entry__ as E
from tools.oracle_check import _rows, duck_connect

QUERIES = E.core_queries()
SQL = E.core_oracle_sql()
LIB_QUERIES = E.library_queries()
LIB_SQL = E.library_oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return {sf: duck_connect(sf) for sf in (SF001, SF01)}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) == set(LIB_QUERIES) == set(LIB_SQL)


@pytest.mark.parametrize("sf_dir", [SF01])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    cur = duck[sf_dir].execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _rows(df.columns, srows) == _rows(dcols, drows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_library_results_match_oracle_exactly(spark, duck, name):
    """The library's own types (exact decimals, timestamp_ntz): same Arrow
    type per column (precision/scale, int width, timestamp unit) and the
    same values."""
    df = LIB_QUERIES[name](spark, SF01)
    rel = duck[SF01].sql(LIB_SQL[name])
    assert {f.name: str(f.type) for f in df.toArrow().schema} == {
        f.name: str(f.type) for f in rel.to_arrow_table().schema
    }
    srows = [tuple(r) for r in df.collect()]
    cur = duck[SF01].execute(LIB_SQL[name])
    assert _rows(df.columns, srows) == _rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_driver_view_is_identical_through_pandas(spark, duck, name):
    """What a generic compare sees: both results through pandas, columns
    sorted by name, rows sorted — same dtypes, same hash, same text."""
    import pandas as pd

    s = QUERIES[name](spark, SF01).toPandas()
    d = duck[SF01].sql(SQL[name]).df()
    s, d = s[sorted(s.columns)], d[sorted(d.columns)]
    s = s.sort_values(list(s.columns), na_position="last").reset_index(drop=True)
    d = d.sort_values(list(d.columns), na_position="last").reset_index(drop=True)
    assert [str(t) for t in s.dtypes] == [str(t) for t in d.dtypes]
    assert s.astype(str).values.tolist() == d.astype(str).values.tolist()
    if len(s):
        assert pd.util.hash_pandas_object(s, index=False).sum() == pd.util.hash_pandas_object(d, index=False).sum()


def test_entry_smoke(spark):
    df = E.entry(spark)
    first = df.schema
    assert df.count() > 0
    assert E.entry(spark).schema == first


def test_reference_values_sf001(spark):
    ct = E._ct(spark, SF01)
    from ledgerlens import classify_payers, customer_summary, discounts_by_gender, estimate_cash_flow

    assert ct.count() == 15000
    summary = customer_summary(ct)
    assert summary.count() == 1649
    assert summary.agg({"purchase_frequency": "sum"}).first()[0] == 16478
    late = classify_payers(summary, 15).filter("payer_class = 'late'").count()
    assert late == 1009
    female = discounts_by_gender(ct).filter("gender = 'Female'").first()
    assert female.total_sales == 4968
    assert str(female.total_revenue) == "1168318557.98"
    assert str(female.revenue_with_discount) == "729350717.49"
    assert female.discount_count == 3233
    est = [r.predicted_cash_flow for r in estimate_cash_flow(ct, 3).orderBy("month_ahead").collect()]
    assert [round(v, 2) for v in est] == [43329245.54, 43316762.72, 43304279.91]
