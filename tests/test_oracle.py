"""Every core query that has SQL gives the SQL's rows on the smallest test data; the others run."""

import glob
import os

import duckdb
import pytest

from engrava.plans import catalog


@pytest.fixture(scope="module")
def oracle(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, oracle):
    df = catalog.queries()[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.oracle_sql():
        return
    r = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(str(tuple(x[c] for c in sorted(r.columns))) for x in rows) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())
