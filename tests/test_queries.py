"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from listingops.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, float):
            return f"{v:.5f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in SQL:
        assert got.count() > 0 and got.columns
        return
    assert rows(got.toPandas()) == rows(duck.sql(SQL[name]).df())


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[:3] == ["lot_id", "section", "group_key"]


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) >= set(QUERIES)
