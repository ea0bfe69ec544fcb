"""Every registered retrieval query against its DuckDB SQL at the smallest scale."""

import os

import duckdb
import pytest

from lateweave.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})")
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())
