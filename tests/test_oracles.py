"""Every query with SQL against DuckDB, rows and types, and the others for running at all."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tessera.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "i", "int": "i", "double": "f", "float": "f", "string": "s", "boolean": "b"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canon(columns, rows):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in by], sorted((tuple(r[i] for i in by) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for g, w in zip(*(x[1] for x in (got, want))):
        for a, b in zip(g, w):
            assert type(a) is type(b) or {type(a), type(b)} <= {int, float} and a == b or str(a) == str(b), (g, w)
            assert a == b or isinstance(a, float) and (abs(a - b) <= 1e-9 * max(1, abs(a)) or a != a and b != b) or str(a) == str(b), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 1


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())
