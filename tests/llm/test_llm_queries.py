import os

import duckdb
import pytest

from shiftscope.llm import queries as llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = c.execute(llm.oracle_sql()[name]).df()
    got = llm.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
