"""The correctness gate, locally: every registered query against its DuckDB twin on sf0.001."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as se
from conftest import SF_SMALL
from evalspark.plans import catalog, oracle
from evalspark.sources.tables import TABLES

QUERIES = dict(catalog.QUERIES)  # the training-data queries have their own tests
ORACLE = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
# queries whose semantics have no SQL twin (Arrow UDF or a stage without a SQL form)
NO_SQL = {"meteor"}


def _norm(df):
    cols = sorted(df.columns)
    df = df[cols].copy()
    for c in cols:
        df[c] = df[c].map(
            lambda v: None
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v))
            else (round(v, 9) if isinstance(v, float) else v)
        )
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_twin_or_is_listed():
    assert set(QUERIES) - set(ORACLE) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    exp = con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _norm(got) == _norm(exp)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"model", "overall_mean"}
