"""Every registered query with a SQL oracle matches DuckDB on the small fixture (sf0.001)."""
import duckdb
import pytest

from threadtox.plans import catalog
from threadtox.sources.tables import TABLES

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracles import rows_of  # noqa: E402

NAMES = [n for n, q in catalog.queries().items() if q.sql is not None and not q.heavy]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    q = catalog.QUERIES[name]
    df = q.build(spark, sf)
    res = con.execute(q.sql)
    dcols = [d[0] for d in res.description]
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, res.fetchall())


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["n_splits", "mean_auroc", "sem_auroc"]
    assert df.count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
