"""Every registered graph query against its SQL on the smallest tables, but for the ones that walk far."""

import os

import duckdb
import pytest

from quiver import program_queries  # noqa: F401
from quiver.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
FAR = {"g01_backward_slice", "g02_forward_slice", "g13_dead_methods", "k04_reach_through_calls", "s09_deep_closure", "k13_views"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FAR))
def test_query_agrees_with_sql(spark, con, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr)
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y)
