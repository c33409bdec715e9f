"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from treelode.checks import oracle
from treelode.checks.queries import registered

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registered(), oracle.statements()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, (int, float)) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
    assert plain(map(tuple, found.select(*columns).collect())) == plain(expected.fetchall())


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", QUERIES)
def test_no_cross_join_and_no_repeated_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = len(re.findall("ArrowEvalPython|MapInArrow", plan))
    assert python <= {"file_imports": 7, "search_text": 2, "knn_batch": 2, "knn_cosine": 2}.get(name, 1)


@pytest.mark.parametrize("name", ["chunk_fixed", "chunk_headings", "warning_lines", "content_hash", "html_outline", "scan_filter"])
def test_row_local_operators_do_not_shuffle_by_key(spark, name):
    assert "hashpartitioning" not in plan_of(QUERIES[name](spark, FOLDER))


def test_entry(spark):
    assert entry.entry(spark).count() == 10
