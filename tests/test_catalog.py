"""Every query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, db):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        # Held against brute force in test_cluster.py and test_density.py.
        assert name in ("c03_average_linkage", "c03_density_clusters")
        return
    want = db.sql(sql)
    names = list(want.columns)
    assert sorted(names) == columns
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in want.fetchall())
