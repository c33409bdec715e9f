"""Registered chunkers: from SQL, in the dispatch, and in an indexing run."""
import re
import sys

from pyspark import cloudpickle

from treelode.operators.chunkers import Chunkers
from treelode.operators.chunking import chunk_files, chunk_windows
from treelode.operators.embedding import HashingEmbedder
from treelode.plans.reindex import reindex
from treelode.sources.store import ChunkStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def statements(path, text):
    """Every statement up to a semicolon is a chunk."""
    line = 1
    for part in re.findall(r"[^;]+;", text):
        body = part.lstrip("\n")
        first = line + len(part) - len(body)
        yield "function", body.split()[0], body, first, first + body.count("\n")
        line += part.count("\n")


def own():
    made = Chunkers()
    made.register("sql", statements)
    made.register(".bad", lambda path, text: 1 / 0)
    made.register(".wrong", lambda path, text: [("function", "x", "y", 0, 99)])
    return made


SQL = "select 1\nfrom t;\n\ninsert into t\nvalues (2);"


def test_lateral_call_from_sql(spark):
    own().install(spark)
    spark.createDataFrame([("a.sql", SQL), ("b.py", "x"), ("c.sql", None), (None, "x"), ("d.sql", "")], "file_path string, content string").createOrReplaceTempView("own_files")
    found = spark.sql("SELECT f.file_path, c.ordinal, c.name, c.line_start, c.line_end FROM own_files f, LATERAL own_chunks(f.file_path, f.content) c")
    assert sorted(map(tuple, found.collect())) == [("a.sql", 0, "select", 1, 2), ("a.sql", 1, "insert", 4, 5)]


def test_dispatch_prefers_registered_chunkers(spark, files):
    long = "\n".join(f"row {n}" for n in range(450))
    frame = files({"db/a.sql": SQL, "db/b.py": "def f():\n    pass\n", "docs/g.md": "# A\none\n", "x/c.bad": long, "x/d.wrong": "short"})
    rows = {(r.file_path, r.chunk_type, r.name, r.line_start, r.line_end) for r in chunk_files(frame, own()).collect()}
    assert {r for r in rows if r[0] == "db/a.sql"} == {("db/a.sql", "function", "select", 1, 2), ("db/a.sql", "function", "insert", 4, 5)}
    assert {r[0] for r in rows} == {"db/a.sql", "db/b.py", "docs/g.md", "x/c.bad", "x/d.wrong"}
    # What fails is cut as code without rules.
    windows = chunk_windows(frame.where("file_path like 'x/%'")).drop("id").collect()
    assert sorted(map(tuple, windows)) == sorted(map(tuple, chunk_files(frame.where("file_path like 'x/%'"), own()).drop("id").collect()))
    same = chunk_files(frame.where("extension in ('.py', '.md')"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, chunk_files(frame.where("extension in ('.py', '.md')"), own()).collect()))
    first = chunk_files(frame, own()).where("name = 'insert'").first()
    assert first.content == "// File: db/a.sql\n\ninsert into t\nvalues (2);"


def test_an_indexing_run_takes_a_new_language(spark, tree):
    made = own()
    made.register(".zig", statements)
    root = tree({"src/a.zig": SQL, "src/b.py": "x = 1\n"})
    totals = reindex(spark, root, HashingEmbedder(16), made)
    assert (totals.files_processed, totals.chunks_created) == (2, 3)
    assert {r.name for r in ChunkStore(spark, root).chunks().where("file_path = 'src/a.zig'").collect()} == {"select", "insert"}
