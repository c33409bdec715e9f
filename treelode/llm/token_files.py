"""Token ids as flat binary files that are memory-mapped, with 64-bit document offsets.

A folder has one shard per partition of a range partitioning by doc_id: `<shard>.bin`, the unsigned little-endian ids of its
documents one after the other (16 bits where the vocabulary allows it, else 32); `<shard>.off`, 64-bit unsigned offsets
in ids, one for each document and the end; `<shard>.doc`, 64-bit doc_ids. Shards in name order are in ascending doc_id
order. `manifest.json` has the width and, for each shard, its documents, its ids and its base: the ids of all shards
before it, by prefix sums over the shards. A task writes under a name of its own and renames at the end, so a task that
is repeated after a lost executor replaces its shard by the same bytes; without a manifest a folder is not complete.
The folder must be mounted on all machines, because memory maps need files.

Encoding is by the tokenizers library. For a tokenizer that drops white space, as the given one does, a text is cut at
spaces, line ends and tabs and nowhere else, and each distinct piece is encoded once per worker while it is remembered; that
gives the ids of the whole text. Any other tokenizer is given whole texts.

Defined results: null and empty texts have only the end id; a null doc_id comes first and is stored as the lowest 64-bit
integer; rows that repeat a doc_id are in the order of a digest of their texts; an empty table gives a folder without shards
and an empty table; columns other than doc_id and text are not looked at.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.llm.bpe import broadcast_file
from treelode.llm.common import slices, texts_of, whole_text
from treelode.llm.pieces import PieceTable

NO_ID = -(1 << 63)
PIECES_KEPT = 800_000
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
SHARD = "shard string, documents bigint, ids bigint"
_tables: dict[str, PieceTable] = {}


def cuts_at_spaces(raw: str) -> bool:
    """Whether the tokenizer lower-cases, makes white space one space and keeps none: no token of it reaches over a space."""
    model = json.loads(raw)
    normal = (model.get("normalizer") or {}).get("normalizers")
    splits = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return normal == NORMALIZERS and bool(splits) and splits[0] == SPLIT and splits[1:] == BYTES and not any(
        token["lstrip"] or token["rstrip"] or token["single_word"] or re.search(r"\s", token["content"]) for token in model["added_tokens"])


def pieces_of(text: str) -> list[str]:
    """Pieces whose ids, put together, are those of the text, for a tokenizer that cuts_at_spaces().

    Marks stay with the word before them: the tokenizer takes a run of marks as one, and what counts as a mark is known
    only after its normalizers.
    """
    if "<|" not in text:  # a special string in capitals is none
        text = text.encode().lower().decode()
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def piece_table(content: Broadcast) -> PieceTable:
    """One per worker process."""
    if content.value not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        model = Tokenizer.from_str(content.value)
        model.no_truncation()
        model.no_padding()

        def learn(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids, sizes = [], []
            for start in range(0, len(pieces), 20_000):
                for coded in model.encode_batch_fast(pieces[start:start + 20_000], add_special_tokens=False):
                    ids += coded.ids
                    sizes.append(len(coded))
            return np.array(ids, np.int32), np.array(sizes, np.int64)

        _tables.clear()
        _tables[content.value] = PieceTable(learn, PIECES_KEPT)
    return _tables[content.value]


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> dict:
    """Encode every whole text, append the end id, write the folder, and return its manifest."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(True) <= 1 << 16 else 4
    raw = broadcast_file(docs, tokenizer).value.decode()
    content, cut = spark.sparkContext.broadcast(raw), cuts_at_spaces(raw)
    Path(folder).mkdir(parents=True, exist_ok=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.partitionId():06d}"
        parts = {kind: Path(folder, f".{name}.{kind}.{context.taskAttemptId()}") for kind in ("bin", "off", "doc")}
        documents = ids_written = 0
        files = {kind: path.open("wb") for kind, path in parts.items()}
        for batch in slices(batches):
            ids, sizes = piece_table(content).ids_of(map(pieces_of, texts_of(batch))) if cut else piece_table(content).learn(texts_of(batch))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            ends = ids_written + np.cumsum(sizes + 1)
            np.concatenate(([ids_written], ends[:-1])).astype("<u8").tofile(files["off"])
            ids.astype(f"<u{width}").tofile(files["bin"])
            batch.column("id").to_numpy().astype("<i8").tofile(files["doc"])
            documents, ids_written = documents + len(sizes), int(ends[-1])
        np.array([ids_written], "<u8").tofile(files["off"])
        for kind, file in files.items():
            file.flush()
            os.fsync(file.fileno())
            file.close()
            if documents:
                os.replace(parts[kind], Path(folder, f"{name}.{kind}"))
            else:
                parts[kind].unlink()
        if documents:
            yield pa.RecordBatch.from_pydict({"shard": [name], "documents": [documents], "ids": [ids_written]})

    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("id"), whole_text().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    shards = sorted(rows.select("id", "text").mapInArrow(shard, SHARD).collect())  # a row per partition
    bases = np.cumsum([0, *(s.ids for s in shards)]).tolist()
    manifest = {"width": width, "end_id": end_id, "ids": bases[-1],
                "shards": [{"shard": s.shard, "documents": s.documents, "ids": s.ids, "base": base} for s, base in zip(shards, bases)]}
    fresh = Path(folder, ".manifest.json")
    fresh.write_text(json.dumps(manifest))
    os.replace(fresh, Path(folder, "manifest.json"))
    return manifest


def opened(folder: str, shard: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of a shard: ids, offsets (one more than documents), doc_ids."""
    return (np.memmap(Path(folder, f"{shard}.bin"), f"<u{width}", "r"), np.memmap(Path(folder, f"{shard}.off"), "<u8", "r"),
            np.memmap(Path(folder, f"{shard}.doc"), "<i8", "r"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers) of every document in the files.

    A task per shard maps its files.
    """
    manifest = json.loads(Path(folder, "manifest.json").read_text())
    width = manifest["width"]
    shards = [(s["shard"], s["base"]) for s in manifest["shards"]]
    names = spark.createDataFrame(shards, "shard string, base bigint").repartition(max(1, len(shards)), "shard")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                ids, offsets, documents = opened(folder, shard, width)
                for first in range(0, len(documents), 4096):
                    cut = np.array(offsets[first:first + 4097]).astype(np.int64)
                    crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    named = np.array(documents[first:first + 4096])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(named, pa.int64(), mask=named == NO_ID), pa.array(base + cut[:-1], pa.int64()),
                         pa.array(np.diff(cut), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return names.mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
