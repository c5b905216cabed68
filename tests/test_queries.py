"""Every registered query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from docflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    one = lambda v: "NULL" if v is None or (isinstance(v, float) and v != v) or v is pd.NA else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return df[cols].apply(lambda c: c.map(one)).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    a, b = canonical(registry.QUERIES[name](spark, SF).toPandas()), canonical(con.sql(registry.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and (a == b).all().all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "markdown", "n_blocks"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
