"""Scanner, settings and ignore rules."""
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from treelode.functions import globs
from treelode.sources import project as P
from treelode.sources.tree import one_file, scan_files, select_files, with_contents, with_hashes


def paths(spark, root):
    return sorted(r.relative_path for r in scan_files(spark, root).collect())


def test_default_scan(spark, tree):
    root = tree({
        "src/__init__.py": "", "src/_layout.tsx": "x", "src/__tests__/t.js": "x", "src/empty.py": "",
        "src/A.TS": "x", "src/x.d.ts": "x", "src/a.test.ts": "x", "src/j.min.js": "x", "README.md": "x",
        "src/secrets.json": "{}", "src/sub/credentials.yaml": "x", "src/dist/a.ts": "x", "src/foo.bar/baz": "x",
        "src/.hidden/a.ts": "x", "src/.dot.ts": "x", "docs/deep/er/than/the/spread/levels/g.md": "x", "docs/h.mdx": "x",
        "src/node_modules/m/a.js": "x", "other/a.ts": "x", "SRC/upper.ts": "x", "srcs/no.ts": "x", "src/app.vue": "x", "src/key.pem": "x",
    })
    assert paths(spark, root) == sorted([
        "SRC/upper.ts", "src/__init__.py", "src/_layout.tsx", "src/__tests__/t.js", "src/empty.py",
        "docs/deep/er/than/the/spread/levels/g.md", "docs/h.mdx", "src/app.vue"])


def test_lister_and_filter_agree_on_letter_case(spark, tree):
    root = tree({".vectorconfig.json": json.dumps({"include": ["Lib/Core/**/*.ts"], "exclude": []}),
                 "lib/core/a.ts": "x", "LIB/CORE/b.ts": "x", "Lib/core/in/c.ts": "x", "lib/cor/d.ts": "x"})
    listed = {path for path in ("lib/core/a.ts", "LIB/CORE/b.ts", "Lib/core/in/c.ts", "lib/cor/d.ts")}
    config = P.load_config(root)
    frame = spark.createDataFrame([(path,) for path in sorted(listed)], "relative_path string")
    assert paths(spark, root) == sorted(r.relative_path for r in select_files(frame, config, []).collect())
    assert len(paths(spark, root)) == 3


def test_tree_of_many_levels_is_listed_once(spark, tree):
    deep = "src/" + "/".join(f"level{n}" for n in range(12))
    root = tree({f"{deep}/a{n}.py": "x" for n in range(30)} | {"src/top.py": "x"})
    found = scan_files(spark, root)
    assert found.count() == 31
    (Path(root) / "src/top.py").unlink()
    assert found.count() == 31 and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_ignore_files_and_replaced_settings(spark, tree):
    root = tree({
        ".vectorconfig.json": json.dumps({"include": ["lib", "a{b,c}/*.ts"], "exclude": []}),
        ".gitignore": "gen/\n*.sql\n!keep.sql\n/lib/top.py\n!secrets.json\n", ".vectorignore": "keep.sql\nlib/**/x?.go\n",
        "lib/gen/a.py": "x", "lib/q.sql": "x", "lib/keep.sql": "x", "lib/top.py": "x", "lib/in/top.py": "x",
        "lib/secrets.json": "{}", "lib/d/x1.go": "x", "lib/d/x12.go": "x", "ab/z.ts": "x", "ac/d/z.ts": "x",
        "lib/a.test.ts": "x", "lib/GEN/b.py": "x",
    })
    assert paths(spark, root) == sorted(["lib/in/top.py", "lib/d/x12.go", "ab/z.ts", "lib/a.test.ts"])


@pytest.mark.parametrize("lines,path,expected", [
    (["foo"], "a/foo/b", True), (["/foo"], "a/foo", False), (["foo/"], "foo", False), (["foo/"], "foo/b", True),
    (["*", "!*.py"], "a.py", False), (["*", "!*.py"], "d/a.py", True), (["a/b"], "x/a/b", False), (["a/**/b"], "a/b", True),
    (["a/**"], "a/x/y", True), (["**/z"], "q/z", True), (["# c", ""], "# c", False), (["\\#c"], "#c", True),
    (["[ab].ts"], "b.ts", True), (["[!ab].ts"], "b.ts", False), (["FOO"], "foo", True), (["a?c"], "a/c", False),
    (["build", "!build/keep"], "build/keep", True), (["x y  "], "x y", True),
])
def test_ignore_rule(spark, lines, path, expected):
    column = globs.ignored(F.col("p"), globs.ignore_rules(lines))
    assert spark.createDataFrame([(path,)], "p string").select(column).first()[0] is expected


def test_contents_and_hashes(spark, tree):
    import hashlib
    root = tree({"src/bad.py": b"\xff\xfeabc\xe2\x82", "src/empty.py": "", "src/bom.py": b"\xef\xbb\xbfx"})
    found = scan_files(spark, root)
    texts = {r.relative_path: r for r in with_contents(found, root).collect()}
    assert texts["src/bad.py"].content == "��abc�"
    assert texts["src/empty.py"].content == "" and texts["src/bom.py"].content == "﻿x"
    hashes = {r.relative_path: r.hash for r in with_hashes(found, root).collect()}
    assert hashes == {k: hashlib.sha256(v.content.encode()).hexdigest() for k, v in texts.items()}
    by_sql = with_contents(found, root).where(F.sha2("content", 256) != F.col("hash"))
    assert by_sql.count() == 0


def test_single_file_stays_inside_root(spark, tree):
    root = tree({"a.py": "x", ".env": "k=1"})
    assert one_file(spark, root, "a.py").first().content == "x"
    assert one_file(spark, root, "src/../a.py").first().content == "x"
    assert one_file(spark, root, "../project/a.py") is None and one_file(spark, root, "nope.py") is None


def test_settings(tree):
    root = tree({".treeloderc": "# c\n\nauto_index = false\nother=1\nauto_index=true\n"})
    assert P.load_rc(root).auto_index is True
    P.save_rc(root, P.Rc(False))
    assert P.load_rc(root).auto_index is False and P.load_rc(root + "/none").auto_index is False
    assert P.parse_rc("auto_index=TRUE").auto_index is False
    assert P.load_config(root) == P.Config()
    tree({".vectorconfig.json": '{"exclude": ["x/**"], "chunkStrategy": "simple"}'})
    assert P.load_config(root) == P.Config(P.DEFAULT_INCLUDE, ("x/**",), "simple")
    tree({".vectorconfig.json": "not json"})
    assert P.load_config(root) == P.Config()


def test_project_root(tree):
    root = tree({".git/HEAD": "x", "a/b/c.py": "x"})
    assert P.find_project_root(root + "/a/b") == root
    assert P.find_project_root("/") == "/"
