"""Chunkers: goldens, and agreement with plain row functions on random text."""
import random
import re

import pytest
from pyspark.sql import functions as F

from treelode.functions import text as X
from treelode.operators.chunking import chunk_files, chunk_headings, chunk_windows

SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def parts(chunks, path):
    rows = chunks.where(F.col("file_path") == path).orderBy("line_start").collect()
    return [(r.chunk_type, r.name, r.line_start, r.line_end) for r in rows]


def test_windows(files):
    sizes = {1: "", 50: None, 51: None, 200: None, 201: None, 450: None}
    texts = {f"q{n}.sql": "\n".join(f"l{i}" for i in range(n)) if n > 1 else "" for n in sizes}
    chunks = chunk_windows(files(texts)).cache()
    assert parts(chunks, "q1.sql") == [("module", "q1.sql", 1, 1)]
    assert parts(chunks, "q50.sql") == [("module", "q50.sql", 1, 50)]
    assert parts(chunks, "q51.sql") == [("module", "q51.sql:1-51", 1, 51)]
    assert parts(chunks, "q200.sql") == [("module", "q200.sql:1-200", 1, 200)]
    assert [p[1] for p in parts(chunks, "q201.sql")] == ["q201.sql:1-200", "q201.sql:201-201"]
    assert [p[1] for p in parts(chunks, "q450.sql")] == ["q450.sql:1-200", "q450.sql:201-400", "q450.sql:401-450"]
    for path, text in texts.items():  # windows put together again are the file
        rows = chunks.where(F.col("file_path") == path).orderBy("line_start").collect()
        assert "\n".join(r.content.removeprefix(f"// File: {path}\n\n") for r in rows) == text
    assert chunks.select("id").distinct().count() == chunks.count()


@pytest.mark.parametrize("text,expected", [
    ("# A\nx\n## B\ny", [("g.md", 1, 2), ("B", 3, 4)]),
    ("\n# A\nx", [("A", 2, 3)]),
    ("p\n#### D\nq", [("g.md", 1, 3)]),
    ("p\n#no\nq", [("g.md", 1, 3)]),
    ("p\n```\n# c\n```", [("g.md", 1, 2), ("c", 3, 4)]),
    (" \n\t\n", []),
    ("# A\n# B", [("g.md", 1, 1), ("B", 2, 2)]),
    ("x\n#  \ny", [("g.md", 1, 1), ("", 2, 3)]),
    ("x\n# \ny", [("g.md", 1, 3)]),
    ("x\n### C \r\ny", [("g.md", 1, 1), ("C", 2, 3)]),
    ("x\n#\u00a0N\u3000\ny", [("g.md", 1, 1), ("N", 2, 3)]),
])
def test_headings(files, text, expected):
    found = parts(chunk_headings(files({"docs/g.md": text})), "docs/g.md")
    assert found == [("doc_section", *e) for e in expected]


def plain_headings(text):
    """The same cut, one line at a time."""
    sections, name, start, held = [], "f.md", 0, []
    lines = text.split("\n")
    for i, line in enumerate(lines + [None]):
        match = line is not None and re.match(rf"(#{{1,3}})[{SPACES}]+([^\n\r\u2028\u2029]+)", line)
        if line is None or (match and held):
            body = "\n".join(held).strip(SPACES)
            if body:
                sections.append((name, f"// File: docs/f.md\n// Section: {name}\n\n{body}", start + 1, i))
            if line is None:
                break
            name, start, held = match.group(2).strip(SPACES), i, [line]
        else:
            held.append(line)
    return sections


def test_random_documents(spark, files):
    rng = random.Random(7)
    bits = ["# ", "## h", "####", "#", " ", "a", "\n", "\n", "\r\n", "\ufeff", "\u00a0", "\u2028", "\t", "\u00e9", "//", "TODO", "\u0085"]
    texts = {f"docs/{i}/f.md": "".join(rng.choice(bits) for _ in range(rng.randrange(60))) for i in range(200)}
    rows = chunk_headings(files(texts)).collect()
    for path, text in texts.items():
        found = [(r.name, r.content.replace(path, "docs/f.md"), r.line_start, r.line_end) for r in rows if r.file_path == path]
        assert sorted(found, key=lambda r: r[2]) == plain_headings(text)

    def plain_warnings(text):
        opener, found = rf"(?://|#|/\*|\*)[{SPACES}]*", []
        for i, line in enumerate(text.split("\n")):
            line = line.strip(SPACES)
            if re.match(opener + "(?:TODO|FIXME|HACK|NOTE|WARN|@deprecated)", line, re.I | re.A):
                found.append(f"L{i + 1}: " + re.sub("^" + opener, "", line).strip(SPACES))
        return found

    def plain_preview(text):
        return "\n".join([line for line in text.split("\n") if not line.startswith("//")][:8])

    frame = files(texts).select("file_path", X.warning_lines(F.col("content")).alias("w"),
                                X.preview_of(F.col("content")).alias("p"), X.line_count(F.col("content")).alias("n"))
    for r in frame.collect():
        text = texts[r.file_path]
        assert (r.w, r.p, r.n) == (plain_warnings(text), plain_preview(text), text.count("\n") + 1)


def test_dispatch(files):
    long_ts = "\n".join(["import 'm'", "function a() {", *["  x()"] * 60, "}", "loose()", "class B {}"])
    chunks = chunk_files(files({
        "src/a.ts": long_ts, "src/none.ts": "\n".join(["x()"] * 60), "src/s.ts": "function q() {}", "docs/g.md": "a\n# h\nb",
        "src/a.vue": "\n".join(["x"] * 60), "src/a.json": "{}",
    })).cache()
    assert parts(chunks, "src/a.ts") == [("function", "a", 2, 63), ("component", "B", 65, 65)]
    assert parts(chunks, "src/none.ts") == [("module", "none.ts", 1, 60)]
    assert parts(chunks, "src/s.ts") == [("module", "s.ts", 1, 1)]
    assert parts(chunks, "docs/g.md") == [("doc_section", "g.md", 1, 1), ("doc_section", "h", 2, 3)]
    assert parts(chunks, "src/a.vue") == [("module", "a.vue:1-60", 1, 60)]
    assert parts(chunks, "src/a.json") == [("module", "a.json", 1, 1)]
    first = chunks.where("name = 'B'").first()
    assert first.content == "// File: src/a.ts\n// Exports: a, B\n// Imports: m\n\nclass B {}"
    assert chunks.where("name = 's.ts'").first().content == "// File: src/s.ts\n// Exports: q\n\nfunction q() {}"


def test_text_that_cannot_be_cut_falls_back_to_windows(files, monkeypatch):
    from treelode.operators import chunking
    monkeypatch.setattr("treelode.operators.outline.statements_of", lambda c, e: F.lit(None).cast(
        "array<struct<head:string,row_start:int,row_end:int>>"))
    frame = files({"src/a.ts": "\n".join(["function a() {}"] * 60)})
    assert parts(chunking.chunk_files(frame), "src/a.ts") == [("module", "a.ts:1-60", 1, 60)]
    from treelode.operators.outline import file_outline
    assert file_outline(frame).first().error == "PARSE_FAILED"


@pytest.mark.parametrize("distance,score", [(0.0, 1.0), (0.5, 0.5), (1.26, -0.26), (2.0, -1.0), (4.0, -3.0), (1.125, -0.12)])
def test_score(spark, distance, score):
    assert spark.range(1).select(X.score_of(F.lit(distance))).first()[0] == score


def test_paths(spark):
    frame = spark.createDataFrame([("a/b/c.d.ts",), ("x.py",), ("src/foo.bar/baz",), ("a\\b.go",)], "p string")
    p = F.col("p")
    rows = frame.select(X.dir_name(p), X.base_name(p), X.extension_of(p), X.normal_path(p)).collect()
    assert [tuple(r) for r in rows] == [
        ("a/b", "c.d.ts", ".ts", "a/b/c.d.ts"), (".", "x.py", ".py", "x.py"), ("src/foo.bar", "baz", ".bar/baz", "src/foo.bar/baz"),
        (".", "a\\b.go", ".go", "a/b.go")]
