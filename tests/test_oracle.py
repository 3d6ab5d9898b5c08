"""Every registered query with SQL agrees with DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans import oracle
from quarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    """A value as text; signed zeros are one number, lists and arrays one kind."""
    if isinstance(v, float):
        return "null" if v != v else v + 0.0
    if v is None or v is pd.NA or v is pd.NaT:
        return "null"
    return v if isinstance(v, str) or not hasattr(v, "__len__") else str(list(v))


def rows(df, cols):
    return sorted(str(tuple(map(plain, r))) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in oracle.SQL:
        want = duck.execute(oracle.SQL[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        # nullable integers are floats in the one frame and Int64 in the other
        got = got.astype({c: "Int64" for c in cols if str(want[c].dtype) == "Int64"})
        assert rows(got, cols) == rows(want, cols)


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(QUERIES)
