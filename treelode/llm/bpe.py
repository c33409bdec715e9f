"""Byte-level BPE: whole texts to ids and back, by recursive DuckDB queries inside each partition.

Encoding cuts a text into pieces by the pattern. A piece that is a token as a whole is that token. All other pieces
that a worker has not seen yet go into one table with a row per token position, starting with single bytes. A
recursive query joins neighbouring positions with the merge table and contracts in every piece the pair of least rank,
leftmost first, until no pair of any piece can be merged. In pieces of over LONG_PIECE bytes, whose steps would grow with
their length, occurrences of that rank further right are contracted in the same step. This gives the same ids because
a merge never makes a pair of lower rank, which holds for every vocabulary whose tokens were made in the order of their
ranks (the tests check it for the given one). Decoding joins ids with the vocabulary and aggregates the bytes in the
order of positions.

Defined results: null and empty texts have no ids; special strings are ordinary text; rows stay as they are, repeated
ones too; an empty table gives an empty table; columns other than doc_id and text are not looked at. A worker keeps
PIECES_KEPT pieces, the less frequent half of which makes room when they are exceeded, and the pieces of one slice.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treelode.llm.common import slices, texts_of
from treelode.llm.pieces import PieceTable

PIECES_KEPT = 300_000
LONG_PIECE = 64
PIECES_AT_ONCE, TOKENS_AT_ONCE = 16_000, 400_000
"""Pieces in one recursive query, and ids in one that decodes; a longer text is decoded alone."""
STATES_KEPT = 4_000_000
"""Token positions that a recursive query may pile up before it is started afresh from its last state."""

LEFTMOST = """
WITH RECURSIVE tokens(word, place, len, id, step) AS (
  SELECT word, place, len, id, 0 FROM seeds
  UNION ALL
  (WITH pairs AS (
     SELECT l.word, (m.id::BIGINT << 32) + l.place AS merge, l.place + l.len AS right_place, r.len AS right_len
     FROM tokens l JOIN tokens r ON r.place = l.place + l.len JOIN merges m ON m.pair = (l.id::BIGINT << 32) + r.id
     WHERE l.step < {steps}),
   least AS (
     SELECT word, min(merge) & 4294967295 AS place, (min(merge) >> 32)::INT AS id,
            arg_min(right_place, merge) AS right_place, arg_min(right_len, merge) AS right_len
     FROM pairs GROUP BY word)
   SELECT t.word, t.place, CASE WHEN t.place = w.place THEN t.len + w.right_len ELSE t.len END,
          CASE WHEN t.place = w.place THEN w.id ELSE t.id END, t.step + 1
   FROM tokens t JOIN least w ON w.word = t.word AND t.place <> w.right_place))
SELECT t.word, t.place, t.len, t.id, t.step
FROM tokens t JOIN (SELECT word, max(step) AS step FROM tokens GROUP BY word) USING (word, step)
"""

ALL_OF_RANK = """
WITH RECURSIVE tokens(word, place, len, id, step) AS (
  SELECT word, place, len, id, 0 FROM seeds
  UNION ALL
  (WITH pairs AS (
     SELECT l.word, m.id, l.place, l.place + l.len AS right_place, r.len AS right_len
     FROM tokens l JOIN tokens r ON r.place = l.place + l.len JOIN merges m ON m.pair = (l.id::BIGINT << 32) + r.id
     WHERE l.step < {steps}),
   least AS (SELECT word, min(id) AS id FROM pairs GROUP BY word),
   same AS (
     SELECT p.*, row_number() OVER w AS n,
            CASE WHEN lag(p.right_place) OVER w = p.place THEN NULL ELSE row_number() OVER w END AS first_of_run
     FROM pairs p JOIN least USING (word, id) WINDOW w AS (PARTITION BY p.word ORDER BY p.place)),
   chosen AS (
     SELECT * FROM (SELECT *, n - max(first_of_run) OVER (PARTITION BY word ORDER BY place) AS k FROM same)
     WHERE k % 2 = 0)
   SELECT t.word, t.place, t.len + coalesce(c.right_len, 0), coalesce(c.id, t.id), t.step + 1
   FROM tokens t JOIN least USING (word) LEFT JOIN chosen c ON c.place = t.place
   WHERE NOT EXISTS (FROM chosen g WHERE g.right_place = t.place)))
SELECT t.word, t.place, t.len, t.id, t.step
FROM tokens t JOIN (SELECT word, max(step) AS step FROM tokens GROUP BY word) USING (word, step)
"""

DECODE = """
SELECT line, string_agg(bytes, '' ORDER BY place) AS bytes FROM coded JOIN vocabulary USING (id) GROUP BY line
"""


def ranks_of(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Codec:
    """A vocabulary in a DuckDB of the worker, and the pieces encoded last."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = ranks_of(content)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        merges = [((self.ranks[t[:i]] << 32) + self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                  for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", pair=np.array([m[0] for m in merges], np.int64), id=np.array([m[1] for m in merges], np.int32))
        # A byte b stands as the character 256 + b, whose UTF-16 code unit has b as its low byte.
        self._table("vocabulary", id=np.array([*self.ranks.values()], np.int32),
                    bytes=["".join(chr(256 + b) for b in token) for token in self.ranks])
        self.valid = np.zeros(max(self.ranks.values()) + 1, bool)
        self.valid[[*self.ranks.values()]] = True
        self.pieces = PieceTable(self._ids_of, PIECES_KEPT)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _ask(self, query: str, name: str, **columns) -> pa.Table:
        self.db.register(name, pa.table(columns))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return found

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each has."""
        long = np.array([len(piece) > LONG_PIECE for piece in pieces], bool)
        counts, parts = np.zeros(len(pieces), np.int64), []
        for query, of_kind in ((LEFTMOST, ~long), (ALL_OF_RANK, long)):
            chosen = [piece for piece, wanted in zip(pieces, of_kind) if wanted]
            found = [self._contract(query, chosen[n:n + PIECES_AT_ONCE]) for n in range(0, len(chosen), PIECES_AT_ONCE)]
            parts.append(np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in found)]))
            counts[of_kind] = np.concatenate([np.empty(0, np.int64), *(sizes for _, sizes in found)])
        ids = np.empty(counts.sum(), np.int32)
        ids[np.repeat(~long, counts)], ids[np.repeat(long, counts)] = parts
        return ids, counts

    def _contract(self, query: str, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        places = np.arange(len(word)) + word  # an empty place after each piece keeps neighbours apart
        state = {"word": word, "place": places, "len": np.ones(len(word), np.int64),
                 "id": self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]}
        ended: list[dict[str, np.ndarray]] = []
        while len(state["word"]):
            steps = max(4, min(64, STATES_KEPT // len(state["word"])))
            found = self._ask(query.format(steps=steps), "seeds", **state)
            found = {name: found[name].to_numpy() for name in found.column_names}
            going = found.pop("step") == steps
            ended.append({name: column[~going] for name, column in found.items()})
            state = {name: column[going] for name, column in found.items()}
        if not ended:
            return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
        place, ids, words = (np.concatenate([part[name] for part in ended]) for name in ("place", "id", "word"))
        return ids[np.argsort(place)].astype(np.int32), np.bincount(words, minlength=len(pieces))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        return self.pieces.ids_of(map(self.pattern.findall, texts))

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, and how many each has."""
        coded = [piece.encode() for piece in pieces]
        whole = np.array([self.ranks.get(piece, -1) for piece in coded], np.int32)
        ids, sizes = self.contract([piece for piece, rank in zip(coded, whole) if rank < 0])
        counts = np.ones(len(pieces), np.int64)
        counts[whole < 0] = sizes
        filled = np.repeat(whole, counts)
        filled[filled < 0] = ids
        return filled, counts

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids. An id outside the vocabulary is an error."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.valid) and self.valid[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        texts = [b""] * len(sizes)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            start = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + TOKENS_AT_ONCE, side="right")))
            part = slice(int(start), int(ends[last - 1]))
            found = self._ask(DECODE, "coded", line=np.repeat(np.arange(first, last), sizes[first:last]),
                              place=np.arange(part.start, part.stop), id=ids[part])
            for line, text in zip(found["line"].to_pylist(), found["bytes"].to_pylist()):
                texts[line] = text.encode("utf-16-le")[::2]
            first = last
        return texts


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: Broadcast, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hashlib.sha256(vocabulary.value).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value, pattern)
    return _codecs[key]


def broadcast_file(frame: DataFrame, path: str) -> Broadcast:
    """A vocabulary file of a few MB, whose size does not depend on the data."""
    with open(path, "rb") as file:
        return frame.sparkSession.sparkContext.broadcast(file.read())


def list_column(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))


def _with(frame: DataFrame, **columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("doc_id", frame.schema["doc_id"].dataType), *(T.StructField(*x) for x in columns.items())])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    vocabulary = broadcast_file(docs, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coded = codec(vocabulary, pattern).encode(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), list_column(*coded)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, _with(docs, ids=T.ArrayType(T.IntegerType())))


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of ids; null ids give no bytes."""
    vocabulary = broadcast_file(coded, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                ids = batch.column("ids")
                sizes = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
                texts = codec(vocabulary, pattern).decode(ids.flatten().to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return coded.select("doc_id", "ids").mapInArrow(rows, _with(coded, bytes=T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns digests of both.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes), and the ids if asked for.
    Otherwise ids and bytes stay in the worker; encode() and decode() return them.
    """
    vocabulary = broadcast_file(docs, path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coder = codec(vocabulary, pattern)
            ids, sizes = coder.encode(texts_of(batch))
            listed = (",".join(map(str, part.tolist())) for part in np.split(ids, np.cumsum(sizes)[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in coder.decode(ids, sizes)], pa.string()),
                 *([list_column(ids, sizes)] if with_ids else [])], schema.names)

    listed = {"ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    schema = _with(docs, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType(), **listed)
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
