import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in Path(SF).iterdir():
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def rows(frame, columns):
    return sorted(map(repr, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", catalog.queries())
def test_query_equals_its_sql(spark, oracle, name):
    found = catalog.queries()[name](spark, SF).toPandas()
    want = oracle.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert rows(found, columns) == rows(want, columns)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_pruning_and_pushdown(spark):
    plan = catalog.queries()["scan_pruned_lineitem"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_quantity), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_llm_folder(tmp_path):
    """The rest works when the folder and the pipeline are gone."""
    for path in ROOT.rglob("*.py"):
        inside = path.relative_to(ROOT)
        if inside.parts[:2] not in (("quern", "llm"), ("tests", "llm")) and inside.name != "corpus_pipeline.py":
            (tmp_path / inside).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / inside).write_bytes(path.read_bytes())
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') for n in names) and 'pipeline' not in names; assert set(e.oracle_sql()) <= names"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
