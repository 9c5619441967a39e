import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from shiftscope import queries as library

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET temp_directory = ''")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(library.queries()))
def test_query(spark, oracle, name):
    got = library.queries()[name](spark, SF).toPandas()
    sql = library.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = oracle.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 36


def test_library_stands_without_the_removable_part(tmp_path):
    for name in ("__spark_entry__.py", "shiftscope"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "shiftscope" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 50 and not any(k.startswith('op') for k in n) and 'pipeline' not in n; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_searched_queries_read_sentences_once(spark):
    """One scan and one search a query, no join with edges, and at most results exchanged."""
    queries = library.queries()
    for names, most in (("rel_head_pos rel_closeh sfiller_long sfiller_filtered_pos", 0), ("fillers_exploded paths_terminal construction_open sfiller_wide cell_sizes path_combos", 1)):
        for name in names.split():
            plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert (plan.count("FileScan"), plan.count("MapInArrow"), plan.count("Join")) == (1, 1, 0) and plan.count("Exchange ") <= most, name
    # the walks have been done, once, when its counts are compared
    assert "MapInArrow" not in queries["sfiller_tvd"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
