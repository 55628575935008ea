"""Every query of the core against its SQL."""

import importlib

import pytest

import __spark_entry__ as entry
from compare import plain, rows_of

CORE = {n: (m.QUERIES[n], m.SQL.get(n)) for m in map(importlib.import_module, entry.MODULES) for n in m.QUERIES}


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, data, name):
    query, sql = CORE[name]
    df = query(spark, data)
    mine = rows_of(df.columns, df.collect())
    if sql is None:
        assert mine
        return
    r = duck.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert mine == rows_of(r.columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key_kind", "key_id"]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert plain(float("nan")) == "nan"
