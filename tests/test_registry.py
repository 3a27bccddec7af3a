"""Every registered query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

from .conftest import SMALL

TABLES = ('region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels '
          'conversations').split()
QUERIES = entry_module.queries()
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope='module')
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize('name', list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in frame.select(*columns).collect())
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
