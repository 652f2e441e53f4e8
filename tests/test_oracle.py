"""Every registered query with a SQL check equals DuckDB on the same tables."""
import math

import duckdb
import pytest

from conftest import SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def _keys():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("key", _keys())
def test_matches_duckdb(spark, con, key):
    import __spark_entry__ as E
    sdf = E.queries()[key](spark, SMALL)
    srows, scols = sdf.collect(), sdf.columns
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    assert sorted(tuple(_norm(r[i]) for i in si) for r in srows) == \
        sorted(tuple(_norm(r[i]) for i in di) for r in drows)


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25
    assert df.columns == ["segment", "segment_value", "vulnerable_pct", "mean_posture", "n"]
