"""Every query of the library against the SQL that gives the same rows, on the smallest tables."""

import math

import duckdb
import pytest

from gleanery.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    cur = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    out = registry.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(cols)
    assert sorted(repr([plain(r[c]) for c in cols]) for r in out.collect()) == sorted(repr([plain(v) for v in r]) for r in cur.fetchall())


def test_all_queries_have_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"cluster_assign"}  # fitted; tests/test_library.py covers it
