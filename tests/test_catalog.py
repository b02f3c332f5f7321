"""Every registered core query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from packrel.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = sorted(map(repr, rel.select(*[f'"{c}"' for c in cols]).fetchall()))
    assert got == want
