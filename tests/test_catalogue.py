"""The catalogue against its SQL on the smallest tables, the layering, and the pipeline."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from groundline import queries as core

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(rows):
    def value(v):
        return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    return sorted([tuple(value(v) for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({core.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    df = core.QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_llm_imports_it():
    for path in [*ROOT.glob("groundline/**/*.py"), *ROOT.glob("*.py")]:
        if "llm" in path.parts or path.name == "__spark_entry__.py":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] + [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n for n in names), path


def test_pipeline_refuses_before_retrieval(spark):
    rows = core.QUERIES["answer_pipeline"](spark, DATA).collect()
    assert {r.mode for r in rows} <= {"fact", "refuse"}
    assert all((r.mode == "fact") == (r.stopped_at == "answered") == (r.reason == "") for r in rows)
    assert all(r.source_url == "" and r.last_updated == "" for r in rows if r.mode == "refuse")
