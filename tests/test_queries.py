"""Registered search queries against their SQL in DuckDB, and the entry module without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from findlark import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages part events".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_equals_sql(spark, sql, name):
    assert rows(q.QUERIES[name](spark, SF).toPandas()) == rows(sql.execute(q.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "findlark", tmp_path / "findlark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
