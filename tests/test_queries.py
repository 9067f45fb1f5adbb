"""Every query of the findings engine against its SQL in DuckDB, and the entry points without the optional parts."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from ferrule.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.toArrow()
    want = db.execute(queries.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted((tuple(plain(v) for _, v in sorted(r.items())) for r in t.to_pylist()), key=repr)
    assert rows(got) == rows(want)


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_without_the_optional_parts(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root / "ferrule", tmp_path / "ferrule", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'taint_scan' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); e.oracle_sql()"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
    run()
    # The pipeline without its package, and the package without a library that it needs.
    (tmp_path / "corpus_pipeline.py").write_text("from ferrule.llm import langid\n")
    run()
    (tmp_path / "ferrule" / "llm").mkdir()
    (tmp_path / "ferrule" / "llm" / "__init__.py").write_text("")
    (tmp_path / "ferrule" / "llm" / "queries.py").write_text("import a_library_that_is_not_here\n")
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_here\n")
    run()


@needs_data
def test_results_stay_where_their_documents_are(spark):
    """sarif_results deals lines and keys to documents, and nothing after that: neither results nor their groups are shuffled again, and only SARIF is read."""
    plan = queries.QUERIES["sarif_results"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("REPARTITION_BY_COL") == 2 and "Union" not in plan and "ArrowEvalPython" not in plan


def sarif_plan(spark):
    return queries.QUERIES["sarif_results"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_documents_get_the_orders_alone(spark):
    """The lists of orders beside the documents are made of the order and nothing else, already when they are read."""
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in sarif_plan(spark)


@needs_data
def test_results_that_are_alike_are_counted_in_one_sort(spark):
    plan = sarif_plan(spark)
    assert not re.search(r"(?<!Object)HashAggregate\(", plan) and plan.count("Window [") == 2 and plan.count("- Sort [") == 1


@needs_data
def test_results_of_repeated_and_incomplete_lines(spark, db, tmp_path):
    """Lines that come twice and three times count as often; one without an order, a part or a flag is a result as well, one without a supplier is in no document."""
    db.execute(f"COPY (SELECT l.* FROM (SELECT * FROM lineitem LIMIT 300) l, range(CAST(2 + l.l_linenumber % 2 AS BIGINT))) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    rows = lambda t: sorted((tuple(plain(v) for _, v in sorted(r.items())) for r in t.to_pylist()), key=repr)
    other = duckdb.connect()
    other.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = queries.QUERIES["sarif_results"](spark, str(tmp_path)).toArrow()
    assert rows(got) == rows(other.execute(queries.SQL["sarif_results"]).to_arrow_table()) and {r["n"] for r in got.to_pylist()} == {2, 3}
    odd = tmp_path / "odd"
    odd.mkdir()
    columns = "CASE WHEN i = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, CASE WHEN i = 1 THEN NULL ELSE l_partkey END AS l_partkey, CASE WHEN i = 2 THEN NULL ELSE l_returnflag END AS l_returnflag, CASE WHEN i = 3 THEN NULL ELSE l_suppkey END AS l_suppkey"
    other.execute(f"COPY (SELECT * REPLACE ({columns}) FROM (SELECT * FROM lineitem WHERE l_linenumber IN (1, 2) LIMIT 80), range(4) r(i)) TO '{odd}/lineitem.parquet' (FORMAT parquet)".replace("* REPLACE", "* EXCLUDE (i) REPLACE"))
    got = queries.QUERIES["sarif_results"](spark, str(odd)).toArrow().to_pylist()
    count = lambda q: dict(other.execute(f"SELECT l_suppkey, count(*) FROM '{odd}/lineitem.parquet' WHERE l_suppkey IS NOT NULL AND {q} GROUP BY 1").fetchall())
    summed = lambda some: {k: sum(r["n"] for r in got if r["doc"] == k and some(r)) for k in {r["doc"] for r in got if some(r)}}
    assert summed(lambda r: True) == count("true") and summed(lambda r: r["item"] is None) == count("l_orderkey IS NULL")
    assert len({tuple(sorted((k, repr(v)) for k, v in r.items() if k != "n")) for r in got}) == len(got)
