"""Index, search and the JSON messages, end to end."""
import json
import shutil
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle

from treelode.operators.embedding import HashingEmbedder
from treelode.plans import tools as A
from treelode.plans.reindex import reindex
from treelode.sources import project as P
from treelode.sources.store import ChunkStore, ConcurrentCommit

cloudpickle.register_pickle_by_value(sys.modules[__name__])
DIM = HashingEmbedder(64)
SOURCE = {
    "src/a.py": "from os import path\n\ndef alpha():\n    return 1\n",
    "src/b.ts": "\n".join(["// c", "export function useThing() {", *["  x();"] * 60, "}", "// TODO later", "const y = 1"]),
    "docs/g.md": "# Guide\nwords here\n## Setup\ninstall the thing\n",
    "src/q.sql": "\n".join(f"select {i}" for i in range(450)),
}


def stored(spark, root):
    rows = ChunkStore(spark, root).chunks().collect()
    return {(r.file_path, r.chunk_type, r.name, r.content, r.line_start, r.line_end, r.id, tuple(r.vector)) for r in rows}


def totals(t):
    return (t.files_processed, t.chunks_created, t.files_deleted, t.chunks_embedded)


def test_incremental_run_equals_rebuild(spark, tree, tmp_path):
    root = tree(SOURCE)
    assert totals(reindex(spark, root, DIM)) == (4, 1 + 2 + 2 + 3, 0, 8)
    assert totals(reindex(spark, root, DIM)) == (0, 0, 0, 0)
    tree({"src/a.py": "def beta():\n    pass\n", "src/new.go": "package x\n"})
    Path(root, "src/q.sql").unlink()
    assert totals(reindex(spark, root, DIM)) == (2, 2, 1, 2)
    Path(root, "docs/g.md").unlink()
    assert totals(reindex(spark, root, DIM)) == (0, 0, 1, 0)
    tree({"docs/g.md": SOURCE["docs/g.md"]})
    assert totals(reindex(spark, root, DIM)) == (1, 2, 0, 2)

    fresh = tmp_path / "fresh"
    shutil.copytree(root, fresh, ignore=shutil.ignore_patterns(".vectors"))
    reindex(spark, str(fresh), DIM)
    assert stored(spark, root) == stored(spark, str(fresh))

    before = stored(spark, root)
    store = ChunkStore(spark, root)
    meta = {(r.relative_path, r.hash, tuple(r.chunk_ids)) for r in store.meta().collect()}
    assert totals(reindex(spark, root, DIM)) == (0, 0, 0, 0)
    ids = {i for _, _, chunk_ids in meta for i in chunk_ids}
    assert ids == {row[6] for row in before} and store.meta().count() == len({row[0] for row in before})


class NoKey(HashingEmbedder):
    def ready(self):
        raise RuntimeError("no key")


def test_embedder_is_asked_only_when_there_is_something_to_embed(spark, tree):
    root = tree({"src/a.py": "a", "src/b.py": "b"})
    with pytest.raises(RuntimeError):
        reindex(spark, root, NoKey(64))
    assert not A.has_index(spark, root)
    reindex(spark, root, DIM)
    Path(root, "src/b.py").unlink()
    assert totals(reindex(spark, root, NoKey(64))) == (0, 0, 1, 0)
    assert {row[0] for row in stored(spark, root)} == {"src/a.py"}
    tree({"src/c.py": "c"})
    with pytest.raises(ValueError):
        reindex(spark, root, HashingEmbedder(32))
    assert {row[0] for row in stored(spark, root)} == {"src/a.py"}
    assert totals(reindex(spark, root, DIM)) == (1, 1, 0, 1)


def test_one_changed_file_writes_its_bucket_again_and_no_other(spark, tree):
    root = tree({f"src/m{n}.py": f"text {n}" for n in range(60)})
    reindex(spark, root, DIM)
    store = ChunkStore(spark, root)
    before = store.snapshot()
    assert len(before.chunks) > 5 and before.chunks.keys() == before.meta.keys()
    tree({"src/m7.py": "changed"})
    assert totals(reindex(spark, root, DIM)) == (1, 1, 0, 1)
    after = store.snapshot()
    moved = {b for b in after.chunks if after.chunks[b] != before.chunks[b]}
    assert len(moved) == 1 and {b for b in after.meta if after.meta[b] != before.meta[b]} == moved
    rewritten = store.chunks().where(f"bucket = {[*moved][0]}")
    run = after.chunks[[*moved][0]]
    assert store._read("chunks", {b: run for b in moved}).count() == rewritten.count() < 20
    assert store.chunks().count() == 60 and store.chunks().where("content like '%changed%'").count() == 1


def test_counts_are_taken_while_writing(spark, tree):
    from treelode.sources.store import Written
    root = tree({f"src/m{n}.py": f"text {n}" for n in range(40)})
    reindex(spark, root, DIM)
    store = ChunkStore(spark, root)
    parent, rows = store.snapshot(), store.chunks().drop("run", "bucket", "kind", "stored_in")
    run = store.next_run(parent)
    changes = store.chunks().limit(0).selectExpr("file_path AS relative_path", "'' AS extension", "'' AS category", "'' AS absolute_path", "0L AS size", "'' AS change")
    assert store.commit(parent, run, store.stage(changes, run), rows.limit(0), 64) == Written()
    parent, run = store.snapshot(), store.next_run(parent) + 1
    one = store.chunks().where("file_path = 'src/m3.py'").selectExpr("file_path AS relative_path", "'' AS extension", "'' AS category", "'' AS absolute_path", "0L AS size", "'modified' AS change")
    written = store.commit(parent, run, store.stage(one, run), rows.where("file_path = 'src/m3.py'"), 64)
    assert (written.made, written.kept) == (1, 1) and store.chunks().count() == 40
    assert written.carried == store._read("chunks", {b: r for b, r in store.snapshot().chunks.items() if r == run}).count() - 1


def test_all_files_gone_and_back(spark, tree):
    root = tree({"src/a.py": "a", "src/b.py": "b"})
    reindex(spark, root, DIM)
    for name in ("a", "b"):
        Path(root, f"src/{name}.py").unlink()
    assert totals(reindex(spark, root, DIM)) == (0, 0, 2, 0)
    store = ChunkStore(spark, root)
    assert stored(spark, root) == set() and store.snapshot().dimensions == 64 and A.has_index(spark, root)
    assert A.search_code(spark, root, "a", DIM).count() == 0
    tree({"src/a.py": "a"})
    assert totals(reindex(spark, root, DIM)) == (1, 1, 0, 1) and len(stored(spark, root)) == 1


def test_blank_document_is_added_every_time(spark, tree):
    root = tree({"docs/blank.md": " \n\n", "src/a.py": "x"})
    assert totals(reindex(spark, root, DIM)) == (2, 1, 0, 1)
    assert totals(reindex(spark, root, DIM)) == (1, 0, 0, 0)


class Flaky(HashingEmbedder):
    """Refuses any call that holds `needle`, and every batch of more than one text."""

    def __init__(self, needle):
        super().__init__(16)
        self.needle = needle

    def embed(self, texts):
        if len(texts) > 1 or self.needle in texts[0]:
            raise RuntimeError("no")
        return super().embed(texts)


def test_failed_chunk_is_dropped_and_still_counted(spark, tree):
    root = tree({"docs/g.md": "# A\none\n# B\ntwo bad\n", "src/a.py": "x"})
    assert totals(reindex(spark, root, Flaky("bad"))) == (2, 3, 0, 2)
    store = ChunkStore(spark, root)
    assert {r.name for r in store.chunks().collect()} == {"g.md", "a.py"}
    assert [(r.file_path, r.name, r.reason) for r in store.rejected().collect()] == [("docs/g.md", "B", "RuntimeError: no")]
    assert totals(reindex(spark, root, Flaky("bad"))) == (0, 0, 0, 0)


def test_embedding_batches():
    from treelode.operators.embedding import embed_texts

    class Short(HashingEmbedder):
        calls = []

        def embed(self, texts):
            self.calls.append(len(texts))
            return super().embed(texts)[:1]

    assert all(v is not None for v in embed_texts(Short(8), ["a", "b"])) and Short.calls == [2, 1, 1]


def test_concurrent_commit_is_refused(spark, tree):
    root = tree({"src/a.py": "x"})
    store = ChunkStore(spark, root)
    reindex(spark, root, DIM)
    now = store.snapshot()
    with pytest.raises(ConcurrentCommit):
        store._publish(now)
    # A run that died while it published left no finished snapshot.
    (Path(root) / f".vectors/store/snapshot/n={now.number + 1}").mkdir()
    assert store.snapshot() == now and A.has_index(spark, root) and not A.has_index(spark, root + "/src")


def ask(spark, root, tool, **arguments):
    said = A.answer(spark, root, DIM, tool, arguments)
    return (said["text"] if said["is_error"] else json.loads(said["text"])), said["is_error"]


def test_search_messages(spark, tree):
    root = tree(SOURCE)
    text, failed = ask(spark, root, "search_code", query="alpha")
    assert failed and json.loads(text)["error"] == "NO_INDEX"
    assert ask(spark, root, "search_code", query="") == ("Error: give a value for query (string)", True)
    said, failed = ask(spark, root, "reindex")
    assert not failed and said["files_processed"] == 4 and said["auto_index"] is True
    assert P.load_rc(root).auto_index is True

    said, _ = ask(spark, root, "search_code", query="alpha path os", limit=2)
    assert said["results_count"] == 2 and said["results"][0]["file"] == "src/a.py"
    first = said["results"][0]
    assert list(first) == ["rank", "file", "name", "type", "lines", "score", "preview"]
    assert (first["rank"], first["name"], first["type"], first["lines"]) == (1, "a.py", "module", "1-5")
    assert first["preview"].split("\n")[:2] == ["", "from os import path"]

    said, _ = ask(spark, root, "search_code", query="select", extensions=["ts"])
    assert {r["file"] for r in said["results"]} == {"src/b.ts"}
    said, _ = ask(spark, root, "search_code", query="select", extensions=[])
    assert said["results_count"] == 6
    said, _ = ask(spark, root, "search_docs", query="setup install")
    assert [r["section"] for r in said["results"]][0] == "Setup" and "// Section: Setup" in said["results"][0]["content"]


def test_search_plan(spark, tree):
    """The kind prunes partitions, the type filter and the winning files reach the Parquet scan, nothing is joined to find
    live rows, and the vector scan reads no content."""
    from treelode.operators import search as S

    root = tree(SOURCE)
    reindex(spark, root, DIM)
    tree({"src/a.py": "changed"})
    reindex(spark, root, DIM)
    store = ChunkStore(spark, root)
    chunks = store.chunks("code")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        winners = S.nearest(chunks.where(S.is_code()).select(*S.TIE_BREAK, "stored_in", "vector"), [0.0] * 64, 5)
        plan = winners._jdf.queryExecution().executedPlan().toString()
        lookup = A.with_content(store, winners)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "store/chunks" in line)
    assert "content" not in scan and "kind#" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "Not(EqualTo(chunk_type,doc_section))" in scan.split("PushedFilters")[1]
    assert "TakeOrderedAndProject" in plan and "Join" not in plan
    scan = next(line for line in lookup.split("\n") if "store/chunks" in line)
    assert "paths)[file" in scan and "/kind=code/part-" in scan


def test_results_of_every_size(spark, tree):
    root = tree({f"src/my dir/f{i % 7}/m{i}.ts": f"match {i % 5} word" for i in range(40)})
    reindex(spark, root, DIM)
    every = A.search_code(spark, root, "match word 3", DIM, 2000).collect()
    assert len(every) == 40 and [row.rank for row in every] == [*range(1, 41)]
    assert A.search_code(spark, root, "match word 3", DIM, 12).collect() == every[:12]
    assert A.search_code(spark, root, "match word 3", DIM, 0).count() == 0


@pytest.mark.parametrize("limit", [10, 2000])
def test_reverted_and_restored_files_are_found_once(spark, tree, limit):
    first = {"src/a.py": "match one", "src/b.py": "match two", "docs/g.md": "# T\nmatch\n"}
    root = tree(first)
    reindex(spark, root, DIM)
    tree({"src/a.py": "match changed", "docs/g.md": "# T\nother\n"}, Path(root))
    (Path(root) / "src/b.py").unlink()
    reindex(spark, root, DIM)
    tree(first, Path(root))
    reindex(spark, root, DIM)
    found = A.search_code(spark, root, "match", DIM, limit).collect()
    assert sorted((row.rank, row.file) for row in found) in ([(1, "src/a.py"), (2, "src/b.py")], [(1, "src/b.py"), (2, "src/a.py")])
    docs = A.search_docs(spark, root, "match", DIM, limit).collect()
    assert [(row.rank, row.file) for row in docs] == [(1, "docs/g.md")] and "match" in docs[0].content


@pytest.mark.parametrize("limit", [-1, 2.5, "3", True, float("nan")])
def test_limits_that_are_no_numbers_of_rows(spark, tree, limit):
    root = tree({"src/a.py": "match"})
    reindex(spark, root, DIM)
    said, failed = ask(spark, root, "search_code", query="match", limit=limit)
    assert failed and "limit" in said
    assert ask(spark, root, "search_code", query="match", limit=1.0)[0]["results_count"] == 1


def test_other_failures_become_messages(spark, tree, monkeypatch):
    root = tree({"src/a.py": "match"})
    reindex(spark, root, DIM)
    monkeypatch.setattr(A, "search_code", lambda *_: 1 / 0)
    said, failed = ask(spark, root, "search_code", query="match")
    assert failed and "search_code" in said and "division" in said
    assert all(op.about for op in A.OPERATIONS.values())


def test_root_is_found_around_the_working_directory(spark, tree, monkeypatch):
    root = tree({"src/a.py": "x = 1", ".git/HEAD": "x"})
    monkeypatch.chdir(Path(root) / "src")
    said = A.answer(spark, None, DIM, "get_file_tree")
    assert json.loads(said["text"])["project"] == root


def buckets_on_disk(root):
    return {p.relative_to(root).as_posix() for p in Path(root).glob(".vectors/store/*/run=*/bucket=*")}


def test_runs_without_changes_leave_nothing(spark, tree):
    root = tree({"src/a.py": "match"})
    reindex(spark, root, DIM)
    before = buckets_on_disk(root)
    assert reindex(spark, root, DIM).files_processed == 0 and buckets_on_disk(root) == before


def test_dead_buckets_are_removed_and_never_opened(spark, tree):
    root = tree({"src/a.py": "match one", "src/b.py": "gone soon"})
    reindex(spark, root, DIM)
    (Path(root) / "src/b.py").unlink()
    reindex(spark, root, DIM)
    store = ChunkStore(spark, root)
    now = store.snapshot()
    files = store.chunks().inputFiles()
    assert files and all(any(f"run={run}/bucket={b}/" in name for b, run in now.chunks.items()) for name in files)
    assert store.remove_dead() == 0  # too young
    assert store.remove_dead(older_than_s=0) >= 2
    assert {name.split("store/")[1] for name in buckets_on_disk(root)} == {
        f"{table}/run={run}/bucket={b}" for table, places in (("chunks", now.chunks), ("meta", now.meta)) for b, run in places.items()}
    assert [row.file for row in A.search_code(spark, root, "match", DIM).collect()] == ["src/a.py"]
    assert not any(b"gone soon" in p.read_bytes() for p in Path(root).rglob("*.parquet"))


def test_over_fetch_can_return_fewer(spark, tree):
    names = {f"src/m{i}.ts": "match word" for i in range(6)}
    root = tree({**names, "src/z.py": "other"})
    reindex(spark, root, DIM)
    assert A.search_code(spark, root, "match word", DIM, 2, [".py"]).count() == 0
    assert A.search_code(spark, root, "match word", DIM, 2, ["py"], exact=True).count() == 1


def test_structure_messages(spark, tree):
    root = tree(SOURCE)
    said, _ = ask(spark, root, "get_file_tree")
    assert said["total_files"] == 4 and said["code_files"] == 3 and said["doc_files"] == 1
    assert said["languages"] == [".md", ".py", ".sql", ".ts"]
    assert said["tree"] == {"docs": ["g.md"], "src": ["a.py", "b.ts", "q.sql"]}

    said, _ = ask(spark, root, "get_file_outline", file="src/b.ts")
    assert said == {
        "file": "src/b.ts", "lines": 65, "imports": [], "exports": ["useThing", "y"], "symbols_count": 2,
        "symbols": [{"name": "useThing", "kind": "hook", "lines": "2-63"}, {"name": "y", "kind": "function", "lines": "65-65"}],
        "warnings": ["L64: TODO later"]}
    said, _ = ask(spark, root, "get_file_outline", file="src/q.sql")
    assert said["symbols_count"] == 0 and "warnings" not in said
    said, _ = ask(spark, root, "get_symbol", file="src/b.ts", name="y")
    assert said["source"] == "const y = 1" and said["file_context"] == {
        "imports": [], "exports": ["useThing", "y"], "siblings": ["hook useThing (2-63)"], "warnings": ["L64: TODO later"]}
    said, _ = ask(spark, root, "get_symbol", file="src/b.ts", name="y", context=False)
    assert set(said) == {"file", "symbol", "lines", "source"}

    assert ask(spark, root, "get_symbol", file="src/b.ts", name="zz") == ('Error: Symbol "zz" not found in src/b.ts', True)
    assert ask(spark, root, "get_symbol", file="src/b.ts") == ("Error: give a value for name (symbol name)", True)
    assert ask(spark, root, "get_file_outline") == (
        "Error: give a value for file (relative path from project root)", True)
    assert ask(spark, root, "get_file_outline", file="gone.py") == ("Error: File not found: gone.py", True)
    with pytest.raises(A.UnknownTool):
        A.answer(spark, root, DIM, "drop_everything")


def test_tree_message_is_written_by_tasks_file_by_file(spark, tree):
    names = ["src/a.py", "src/b b.ts", 'src/q"uote.py', "src/ü/日本.md", "src/ü/[x].md", "docs/in/deep/g.md"]
    root = tree({name: "x" for name in names})
    parts = list(A._say_tree(*A.get_file_tree(spark, root), root))
    assert len(parts) == len(names) + 2
    assert json.loads("".join(parts))["tree"] == {
        "docs/in/deep": ["g.md"], "src": sorted(["a.py", "b b.ts", 'q"uote.py']), "src/ü": sorted(["[x].md", "日本.md"])}
    assert json.loads("".join(A._say_tree(*A.get_file_tree(spark, root + "/none"), root)))["tree"] == {}


def test_auto_index(spark, tree):
    root = tree({"src/a.py": "x"})
    assert A.auto_index(spark, root, DIM) is None
    P.save_rc(root, P.Rc(True))
    assert A.auto_index(spark, root, DIM).totals.files_processed == 1

    assert A.auto_index(spark, root, NoKey()) is None
    done = A.reindex(spark, root, DIM, enable_auto_index=False)
    assert done.auto_index is False and P.load_rc(root).auto_index is False and "Nothing has changed" in done.message
