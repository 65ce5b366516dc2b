"""Every query against its oracle SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from kinsift.plans import catalog

TABLES = "events documents embeddings pages benchmark labels conversations"


def plain(rows, columns):
    return sorted(str([r[c] for c in columns]) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        columns = sorted(want.columns)
        assert columns == sorted(df.columns)
        assert plain(rows, columns) == plain([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert entry.entry(spark).columns == ["group_id", "id", "action"]
