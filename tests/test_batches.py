"""Python steps hold a bounded number of bytes as objects, however many rows a batch has."""
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from treelode.functions.batches import SLICE_BYTES, slices
from treelode.operators.embedding import HashingEmbedder, embed_chunks
from treelode.sources.tree import _reader

MB = 1 << 20


def text_bytes(batch):
    return sum(len(text or "") for text in batch.column("content").to_pylist())


def test_files_are_read_in_small_batches(tree):
    root = tree({f"src/m{n}.py": chr(97 + n) * MB for n in range(9)})
    paths = pa.array([f"{root}/src/m{n}.py" for n in range(9)])
    read = list(_reader(root, False)([pa.RecordBatch.from_arrays([paths], ["absolute_path"])]))
    assert max(map(text_bytes, read)) <= SLICE_BYTES + MB
    assert [path for batch in read for path in batch.column("absolute_path").to_pylist()] == paths.to_pylist()


def test_chunks_are_embedded_in_small_batches():
    texts = ["word " * 50_000, None, "", *["a b"] * 3000]
    columns = [pa.array(texts[n:] + texts[:n]) for n in range(2)]
    chunks = SimpleNamespace(schema=T.StructType().add("content", "string").add("other", "string"),
                             mapInArrow=lambda run, _: list(run([pa.RecordBatch.from_arrays(columns, ["content", "other"])])))

    class Lengths(HashingEmbedder):
        def embed(self, texts):
            return [[float(len(text))] * self.dimensions for text in texts]

    found = embed_chunks(chunks, Lengths(512))
    assert max(batch.num_rows for batch in found) * 512 * 4 <= SLICE_BYTES
    joined = pa.Table.from_batches(found).to_pylist()
    assert [row["content"] for row in joined] == columns[0].to_pylist() and [row["other"] for row in joined] == columns[1].to_pylist()
    assert all(row["vector"] == [len(row["content"])] * 512 if row["content"] is not None else row["vector"] is None and row["reason"] for row in joined)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * (3 * MB), "", "y", None])], ["text"])
    assert [part.num_rows for part in slices([batch])] == [1, 1, 3] or [part.num_rows for part in slices([batch])] == [2, 3]
    assert [part.num_rows for part in slices([batch], row_bytes=2 * MB)] == [1] * 5
    assert pa.Table.from_batches(slices([batch], row_bytes=MB)).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
    assert list(slices([batch.slice(0, 0)])) == []
