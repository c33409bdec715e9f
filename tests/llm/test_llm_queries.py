"""The registered queries, their SQL, and the pipeline."""
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from treelode.llm import bpe, queries, secret_spans, toxicity

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", 2: "doc_id fingerprint component_id",
    3: "doc_id n_tokens ids_sha256 decoded_sha256", 4: "doc_id n_words n_hit n_items items_sha256 contaminated", 5: "page_id",
    6: "doc_id start n_tokens ids_crc32", 7: "doc_id held_out score predicted", 8: "doc_id n_assign n_access n_hex base_sha256 spans",
    9: "doc_id held_out n_tokens n_known train_tokens base_score score", 10: "doc_id n_bytes n_tokens over_limit",
    11: "doc_id n_words n_base first_word last_word base_labels labels score", 12: "anchor_id positive_id rank negative_id positive_score negative_score",
    13: "item_id rank doc_id score"}


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", queries.QUERIES)
def test_every_row_is_answered(spark, name):
    frame = entry.queries()[name](spark, FOLDER)
    number = int(name[2:].split("_")[0])
    assert set(COLUMNS[number].split()) <= set(frame.columns)
    if number in (12, 13):  # searches; compared with SQL below
        return
    table = "pages" if number == 5 else "documents"
    assert frame.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", queries.SQL)
def test_matches_sql(spark, views, name):
    frame = entry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    expected = views.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=repr) == sorted(expected, key=repr)


def lowest_of_near_copies(texts):
    """The lowest id of each group linked by five-word shingles of Jaccard similarity 0.8 or more, by all pairs."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))}
    root = {i: i for i in sorted(sets)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in root:
        for b in root:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return [i for i in root if root[i] == i]


def test_pipeline(spark):
    """Every stage against plain Python over what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {row.doc_id: row.text for row in docs.collect()}
    predicted = {row.doc_id: row.predicted for row in toxicity.scores(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()}
    docs = corpus_pipeline.STAGES[0][1](spark, docs, FOLDER)
    assert docs.columns == columns
    kept = {i: text for i, text in kept.items() if not predicted[i]}
    assert {row.doc_id for row in docs.collect()} == set(kept)

    docs = corpus_pipeline.STAGES[1][1](spark, docs, FOLDER)
    firsts = lowest_of_near_copies(kept)
    assert docs.columns == columns and sorted(row.doc_id for row in docs.collect()) == firsts

    docs = corpus_pipeline.STAGES[2][1](spark, docs, FOLDER)
    assert docs.columns == columns and docs.count() < len(firsts)
    learned = secret_spans.learn(docs)
    texts = {row.doc_id: row.text for row in docs.collect()}

    docs = corpus_pipeline.STAGES[3][1](spark, docs, FOLDER)
    assert docs.columns == columns
    clean = {row.doc_id: row.text for row in docs.collect()}
    field = secret_spans.Field(*learned) if learned else None
    assert set(clean) == set(texts) and all(clean[i] == texts[i] for i in texts if not secret_spans.all_spans(texts[i] or "", field))
    assert not any(secret_spans.pattern_spans(text or "") for text in clean.values())

    ranks = bpe.ranks_of(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {row.doc_id: row.ids for row in corpus_pipeline.STAGES[4][1](spark, docs, FOLDER).collect()}
    assert last == {i: model.encode_ordinary(text or "") for i, text in clean.items()}
    assert entry.queries()["pipeline"](spark, FOLDER).count() == len(last)


def test_pipeline_stages_of_odd_rows(spark):
    """Nulls, empty, long and repeated texts, clashing columns, no n_chars, and an empty table, through every stage."""
    long = "word%d " * 3000 % tuple(range(3000))
    rows = [(1, None), (2, ""), (2, ""), (3, long), (4, long + "end"), (4, long + "end"), (None, "no id"), (None, "no id"), (5, "token = abcdef0123456789"), (6, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "'a' AS root", "2 AS key", "3 AS n", "4 AS a", "5 AS `b.c`")
    for frame in (docs, docs.where("false")):
        columns, counts = frame.columns, []
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, frame, FOLDER)
            counts.append(result.count())
            if name != corpus_pipeline.STAGES[-1][0]:
                assert result.columns == columns
                frame = result
        assert counts[-1] == counts[-2]
        if counts[0]:
            assert sorted(((row.doc_id, row.text) for row in frame.collect()), key=repr)[0][0] == 1
            # blank texts are one, the long ones are near copies, and rows that repeat are one row
            assert counts[0] == 10 and counts[1] == 5
