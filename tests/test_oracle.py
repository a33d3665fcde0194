"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "documents benchmark conversations labels pages".split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    types = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    otypes = {d[0]: str(d[1]) for d in cur.description}
    for f in df.schema.fields:
        assert types.get(f.dataType.simpleString(), f.dataType.simpleString()) == otypes[f.name], f.name
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(cols, orows)


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name not in E.oracle_sql():
            assert fn(spark, SF_SMALL).count() >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
