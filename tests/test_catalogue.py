"""Every query of the catalogue against its SQL."""

import os

import duckdb
import pandas as pd
import pytest

from siftwell.plans import catalogue, oracle

QUERIES, SQL = catalogue.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, int) and not isinstance(v, bool) else v

    cols = sorted(df.columns)
    return sorted(repr(tuple(map(plain, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["page_meta", "email_scan_quoted", "emails_per_page", "company_emails"])
def test_page_queries_read_the_whole_table(spark, sf_dir, tmp_path, name):
    """Over a pages table made of the fixture pages they give the fixture query's rows, which have SQL; over the real one, its pages."""
    catalogue.fixture_pages(spark).select("page_id", "url", "html").write.parquet(str(tmp_path / "pages.parquet"))
    assert rows(QUERIES[f"{name}_all"](spark, str(tmp_path)).toPandas()) == rows(QUERIES[name](spark, sf_dir).toPandas())
    found, pages = QUERIES[f"{name}_all"](spark, sf_dir).toPandas(), pd.read_parquet(f"{sf_dir}/pages.parquet")
    if name == "company_emails":
        assert {"domain", "address"} <= set(found.columns) and set(found.page_id) <= set(pages.page_id)
    else:
        assert sorted(found.page_id) == sorted(pages.page_id)


def test_jobs_of_all_orders(spark, sf_dir):
    orders, customers = pd.read_parquet(f"{sf_dir}/orders.parquet"), pd.read_parquet(f"{sf_dir}/customer.parquet")
    names = dict(zip(customers.c_custkey, customers.c_name, strict=True))
    want = [(o, k, names[k]) for o, c in zip(orders.o_orderkey, orders.o_custkey, strict=True) for k in (c, c + 100000) if k in names]
    assert sorted(map(tuple, QUERIES["job_emails_all"](spark, sf_dir).collect())) == sorted(want) and len(want) >= len(orders)


def test_entry_returns_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["source", "address"]
