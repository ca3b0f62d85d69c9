"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronoloom import catalog

FOLDER = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows_of(rows, order):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(clean(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    names = list(want.columns)
    assert sorted(df.columns) == sorted(names)
    assert {k: KINDS[v] for k, v in df.dtypes} == dict(zip(names, map(str, want.types), strict=True))
    got = rows_of([r.asDict() for r in df.collect()], names)
    assert got == rows_of([dict(zip(names, r, strict=True)) for r in want.fetchall()], names)


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0
