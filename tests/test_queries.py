"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import os

import duckdb
import pytest

from strandloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: May be empty on these tables.
EMPTY = {"a6_high_coverage_regions", "c1_detect_linked_read_svs", "c4_detect_large_cnv", "j9_read_pair_support", "w8_gc_rich_regions"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0 or name in EMPTY
