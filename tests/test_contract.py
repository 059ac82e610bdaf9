"""The driver contract: queries agree with their SQL on the smallest tables, and the rest works without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"scorecard_sql", "regressor_quality"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        connection.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return connection


def _plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v
    return sorted(repr([show(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - SLOW))
def test_queries_agree_with_their_sql(spark, tables, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    got = contract.queries()[name](spark, FOLDER)
    want = tables.execute(contract.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(want.fetchall(), names)


def test_entry_runs(spark):
    assert contract.entry(spark).limit(5).count() == 5


def test_the_rest_works_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{root}/terrazzo", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/terrazzo/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
