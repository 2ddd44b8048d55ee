"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from marlspike.plans import catalog


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck(small_dir):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{small_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, small_dir, name):
    df = catalog.QUERIES[name](spark, small_dir)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [dict(zip(columns, r)) for r in found.fetchall()]
    assert got == sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in rows)


def test_entry_runs_and_names_agree(spark):
    df = entry.entry(spark)
    assert len(df.collect()) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
