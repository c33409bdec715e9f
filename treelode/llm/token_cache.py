"""Token counts by a digest cache: a text that was ever counted with a tokenizer is not encoded again.

The cache is a Parquet table of content digest, tokenizer digest and count. Texts are normalised (a null text is the
empty text; nothing else, as byte-level tokenizers tell all other texts apart), digested, and looked up by both digests.
One text of each missing digest is encoded and its count appended; then every row joins the cache.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each have a row, counted once; an empty
table gives an empty table; columns other than doc_id and text are not looked at. A failed append leaves nothing behind;
two runs that append the same digest agree, and either entry is taken. Copies meet as digests: partial aggregation
keeps one text per task and digest, so a third of all rows may be copies of one text.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelode.llm.bpe import broadcast_file
from treelode.llm.common import slices, texts_of, whole_text

ENTRY = "digest binary, tokenizer string, n_tokens bigint"
AT_ONCE = 1 << 18
"""Characters given to the library in one call; a longer text is a call of its own."""
_counters: dict[str, object] = {}


def counter(content: Broadcast, version: str, kind: str):
    """The library's own encoder for a list of texts, one per worker process: .json tokenizers, .model sentencepiece."""
    if version not in _counters:
        _counters.clear()
        if kind == ".model":
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_proto=content.value)
            _counters[version] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        elif kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            model = Tokenizer.from_str(content.value.decode())
            model.no_truncation()
            model.no_padding()
            _counters[version] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            raise ValueError(f"no library for tokenizer files that end in {kind!r}")
    return _counters[version]


def counted(texts: list[str], count) -> list[int]:
    """Counts of all texts, asked for in calls of bounded size."""
    found: list[int] = []
    call: list[str] = []
    held = 0
    for text in texts:
        if call and held + len(text) > AT_ONCE:
            found += count(call)
            call, held = [], 0
        call.append(text)
        held += len(text)
    return found + (count(call) if call else [])


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens that the cache has for a tokenizer, one row per digest."""
    if not _exists(spark, cache):
        return spark.createDataFrame([], ENTRY).select("digest", "n_tokens")
    entries = spark.read.schema(ENTRY).parquet(cache).where(F.col("tokenizer") == version)
    return entries.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, through the cache in the given shared folder.

    Runs one job at once, which appends the counts of what the cache lacks.
    """
    spark = docs.sparkSession
    content = broadcast_file(docs, tokenizer)
    version, kind = hashlib.sha256(content.value).hexdigest(), os.path.splitext(tokenizer)[1]
    texts = docs.select("doc_id", whole_text().alias("text"))
    keyed = texts.withColumn("digest", F.unhex(F.sha2("text", 256)))
    missing = keyed.select("digest", "text").join(cached(spark, cache, version), "digest", "left_anti")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = counted(texts_of(batch), counter(content, version, kind))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([version] * len(counts), pa.string()),
                                              pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))
    distinct.mapInArrow(rows, ENTRY).write.mode("append").parquet(cache)
    sized = keyed.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes"))
    return sized.join(cached(spark, cache, version), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
