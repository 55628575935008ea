"""Every query of the subpackage against its SQL, or its rows only."""

import pytest

from compare import rows_of
from skeinwork.llm import query_modules

QUERIES = {n: (m.QUERIES[n], m.SQL.get(n)) for m in query_modules() for n in m.QUERIES}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, data, name):
    query, sql = QUERIES[name]
    df = query(spark, data)
    mine = rows_of(df.columns, df.collect())
    assert mine
    if sql is not None:
        r = duck.sql(sql)
        assert sorted(df.columns) == sorted(r.columns)
        assert mine == rows_of(r.columns, r.fetchall())
