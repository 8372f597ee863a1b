"""Every registered query that SQL can express, against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lectern.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{round(v, 5) + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert not [c for c, k in kinds.items() if k == "HUGEINT"], "cast integer sums"
    expected = sorted(tuple(map(plain, (float(v) if kinds[c].startswith("DECIMAL") and v is not None else v for c, v in zip(columns, row)))) for row in found.fetchall())
    got = sorted(tuple(map(plain, row)) for row in df.select(*columns).collect())
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
