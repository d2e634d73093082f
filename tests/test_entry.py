"""Driver contract: entry() runs, every query has an oracle, and a sample of
queries match their oracle on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

SAMPLE = ["compute_waterfall", "customer_profitability", "waterfall_alerts", "margin_bridge", "top_outliers",
          "q_full_analysis", "data_checks"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].transaction_count > 0
    assert df.columns[:3] == ["blue_price", "deductions", "invoice_price"]


def test_every_query_has_an_oracle():
    assert set(E.queries()) - set(E.LLM_QUERIES) == set(E.oracle_sql()) - set(E.LLM_ORACLE_SQL)
    assert set(E.LLM_ORACLE_SQL) <= set(E.LLM_QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "part", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def norm(rows):
    return sorted(tuple("" if v is None else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    order = sorted(df.columns)
    srows = [tuple(r[c] for c in order) for r in df.collect()]
    di = [dcols.index(c) for c in order]
    drows = [tuple(r[i] for i in di) for r in res.fetchall()]
    assert norm(srows) == norm(drows)
