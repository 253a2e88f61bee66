"""Every registered engine query against its DuckDB SQL, and the entry point without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from tessera.queries import ORACLE_SQL, QUERIES, TABLES

DATA = "/root/testdata/sf0.001"


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(expected.columns)
    assert _bag(got.columns, map(tuple, got.collect())) == _bag(expected.columns, expected.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["l_orderkey", "l_quantity"]
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLE_SQL) <= set(entry_point.oracle_sql())


def test_entry_point_works_without_the_optional_subpackage(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for p in [root / "__spark_entry__.py", *root.glob("tessera/**/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            to = tmp_path / p.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))], run.stderr
