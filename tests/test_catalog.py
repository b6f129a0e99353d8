"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from orderloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())


def test_entry_without_the_corpus_parts(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() >= 0
