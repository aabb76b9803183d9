"""Every registered query against its DuckDB oracle (row count, columns, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from touchline.sources.testbed import TABLES

from testpaths import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()
CORPUS = set(E._corpus("QUERIES"))


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    """Corpus queries, where installed, have tests of their own (tests/llm)."""
    assert set(QUERIES) - CORPUS == set(ORACLE) - CORPUS and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(set(ORACLE) - CORPUS))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, srows) == _rows(ocols, orows)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["team_id", "team_name", "league_id"]
