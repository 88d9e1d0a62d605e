"""Registered queries of the indexing part against their SQL on the driver's smallest tables, and the import guard."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from corvane.plans import queries

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, sql, name):
    df = queries.QUERIES[name](spark, sf)
    result = sql.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry_returns_rows(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() > 0


def test_everything_else_works_without_the_corpus_operators(tmp_path):
    """A copy without the llm folders and the pipeline still imports and registers the other queries."""
    import shutil

    root = Path(__file__).parent.parent
    shutil.copytree(root / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    # and without Spark's jars, from which nothing is read at import
    code = "import pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_plans_push_down_and_stay_native(spark, sf):
    """Scans read the columns they need, and native queries run no Python."""
    plan = queries.window_chunking(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "Python" not in plan and "Pandas" not in plan
    plan = queries.manifest_diff(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "source" not in plan.split("ReadSchema")[-1]
