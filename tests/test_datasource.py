"""The tree as a data source: planned partitions, pruned directories, pushed filters."""
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from treelode.sources import datasource

FILES = {"a.py": "top", "src/x.ts": "x", "src/deep/er/y.py": "y", "src/empty.py": "", "src/bad.py": b"\xff\xfea", "docs/g.md": "# G", "docs/in/h.MD": "h",
         "lib/node_modules/m.js": "m", "lib/noext": "n", "SRC/up.ts": "u"}


@pytest.fixture(scope="module")
def read(spark):
    datasource.install(spark)

    def load(root, **options):
        return spark.read.format("treelode_tree").options(root=root, **options).load()

    return load


@pytest.mark.parametrize("subtrees", [1, 3, 256])
def test_rows_do_not_depend_on_the_partitions(read, tree, subtrees):
    root = tree(FILES)
    found = read(root, subtrees=subtrees, contents="true")
    texts = {name: text if isinstance(text, str) else text.decode("utf-8", "replace") for name, text in FILES.items() if "node_modules" not in name}
    assert {r.relative_path: r.content for r in found.collect()} == texts
    assert all(r.hash == hashlib.sha256(r.content.encode()).hexdigest() for r in found.collect())
    assert {r.relative_path: r.extension for r in read(root).collect()}["lib/noext"] == ""
    assert found.rdd.getNumPartitions() <= subtrees


def test_include_and_filters(read, tree):
    root = tree(FILES)
    paths = lambda frame: sorted(r.relative_path for r in frame.collect())
    assert paths(read(root, include="src/**\ndocs/*.md")) == ["SRC/up.ts", "docs/g.md", "src/bad.py", "src/deep/er/y.py", "src/empty.py", "src/x.ts"]
    every = read(root)
    assert paths(every.where(F.col("relative_path").startswith("src/d"))) == ["src/deep/er/y.py"]
    assert paths(every.where(F.col("relative_path").endswith(".py") & (F.col("size") > 1))) == ["a.py", "src/bad.py"]
    assert paths(every.where(F.col("extension").isin(".ts", ".md"))) == ["SRC/up.ts", "docs/g.md", "src/x.ts"]
    assert paths(every.where("relative_path = 'src/x.ts' OR relative_path = 'a.py'")) == ["a.py", "src/x.ts"]
    assert read(root + "/none").count() == 0
    with pytest.raises(Exception, match="root"):
        every.sparkSession.read.format("treelode_tree").load().collect()


def test_filters_are_pushed_into_a_frame_of_its_own(spark, read, tree):
    root = tree(FILES)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = read(root, contents="true", pushdown="true").where("relative_path IN ('a.py', 'src/x.ts') AND size = 3")
        assert [(r.relative_path, r.content) for r in found.collect()] == [("a.py", "top")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "size#" in plan.split("Filter")[1].split("BatchScan")[0] and "relative_path" not in plan.split("Filter")[1].split("BatchScan")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_directories_out_of_reach_are_not_listed(tree, monkeypatch):
    root = tree(FILES | {f"other/d{n}/f.py": "x" for n in range(20)})
    listed = []
    real = datasource.TreeReader._below
    monkeypatch.setattr(datasource.TreeReader, "_below", lambda self, fs, base, folder: listed.append(folder) or real(self, fs, base, folder))

    def rows(filters=(), **options):
        reader = datasource.PushingReader({"root": root, **options})
        left = list(reader.pushFilters(list(filters)))
        listed.clear()
        found = [path for part in reader.partitions() for batch in reader.read(part) for path in batch.column(0).to_pylist()]
        return sorted(found), left

    assert rows(include="src/**")[0] == ["SRC/up.ts", "src/bad.py", "src/deep/er/y.py", "src/empty.py", "src/x.ts"]
    assert not any(folder.startswith(("other", "docs", "lib")) for folder in listed)
    found, left = rows([StringStartsWith(("relative_path",), "src/deep"), EqualTo(("extension",), ".py"), EqualTo(("size",), 1)])
    assert found == ["src/deep/er/y.py"] and left == [EqualTo(("size",), 1)] and set(listed) == {"", "src", "src/deep", "src/deep/er"}
    found, _ = rows([In(("relative_path",), ("docs/g.md", "lib/none")), StringEndsWith(("relative_path",), ".md")])
    assert found == ["docs/g.md"] and set(listed) == {"", "docs", "lib"}


@pytest.mark.parametrize("folder, pattern, expected", [
    ("", "src/**", True), ("src", "src/**", True), ("src/a/b", "src/**", True), ("srcs", "src/**", False), ("packages/p", "packages/*/lib/*.ts", True),
    ("packages/p/other", "packages/*/lib/*.ts", False), ("packages/p/lib", "packages/*/lib/*.ts", True), ("packages/p/lib/deep", "packages/*/lib/*.ts", False),
    ("Lib", "lib/**", True), ("b", "{a,b}/c.ts", True), ("x/y/z", "**/q.ts", True)])
def test_reach(folder, pattern, expected):
    assert datasource.may_reach(folder, datasource.parts_of(pattern)) is expected
