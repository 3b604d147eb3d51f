"""Queries against their SQL at the smallest size."""

import math

import duckdb
import pandas as pd
import pytest

from tesselon.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def rows(df, columns):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return str(float(v)) if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in "iuf" and hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(one, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, D).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert rows(a, columns) == rows(b, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2 and set(e.oracle_sql()) <= set(e.queries())
