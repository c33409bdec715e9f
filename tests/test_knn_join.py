"""Nearest rows for a DataFrame of queries, against all pairs."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelode.operators import knn_join
from treelode.operators.knn_join import nearest_join

SCHEMA = "id string, file_path string, line_start int, vector array<float>"


def brute(rows, queries, limit, metric):
    expected = []
    for query_id, target in queries:
        if target is None:
            continue
        scored = []
        for key, path, line, vector in rows:
            if vector is None:
                continue
            a, b = np.array(vector, np.float32).astype(float), np.array(target, np.float32).astype(float)
            if metric == "cosine":
                far = 1.0 if not a.any() or not b.any() else 1 - a @ b / np.sqrt((a @ a) * (b @ b))
            else:
                far = float(((a - b) ** 2).sum())
            scored.append((round(far, 9), path, line, key))
        expected += [(query_id, n + 1, key, far) for n, (far, _, _, key) in enumerate(sorted(scored)[:limit])]
    return sorted(expected, key=repr)


def found(frame):
    return sorted(((r.query_id, r.rank, r.id, round(r._distance, 9) + 0.0) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    seeded = random.Random(2)
    made = [(f"c{n}", f"src/{n % 7}.py", n % 3, [seeded.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(5)]) for n in range(300)]
    return made + [("none", "src/0.py", 1, None), ("zero", "src/0.py", 1, [0.0] * 5)] + [(f"same{n}", "src/s.py", n, [1.0, 2.0, 3.0, 4.0, 5.0]) for n in range(40)]


@pytest.mark.parametrize("metric", [knn_join.SQUARED, knn_join.COSINE])
@pytest.mark.parametrize("slice_rows, limit", [(1 << 14, 3), (50, 7), (16, 400)])
def test_against_all_pairs(spark, monkeypatch, rows, metric, slice_rows, limit):
    monkeypatch.setattr(knn_join, "PACK_ROWS", 16)
    monkeypatch.setattr(knn_join, "QUERIES_AT_ONCE", 5)
    seeded = random.Random(3)
    queries = [(n, [seeded.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(5)]) for n in range(23)]
    queries += [(100, None), (101, [0.0] * 5), (102, [1.0, 2.0, 3.0, 4.0, 5.0])]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("a.b", F.lit(1))
    asked = spark.createDataFrame(queries, "query_id long, vector array<float>")
    result = nearest_join(table, asked, limit, metric, slice_rows)
    assert set(result.columns) == {"query_id", "rank", "_distance", "id", "file_path", "line_start", "a.b"}
    got, expected = found(result), brute(rows, queries, limit, metric)
    if metric == knn_join.COSINE:  # vectors of one direction differ in their last bits only
        distance = {(q, i): d for q, _, i, d in brute(rows, queries, len(rows), metric)}
        assert all(abs(distance[q, i] - d) < 1e-8 for q, _, i, d in got)
        got, expected = ([(q, n, d) for q, n, _, d in side] for side in (got, expected))
        got, expected = sorted(got), sorted(expected)
        assert len(got) == len(expected) and all(g[:2] == e[:2] and abs(g[2] - e[2]) < 1e-8 for g, e in zip(got, expected))
    else:
        assert got == expected


def test_nothing_to_find(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([("q", [0.0] * 5)], "query_id string, vector array<float>")
    assert nearest_join(table.where("false"), asked, 3).count() == 0
    assert nearest_join(table, asked.where("false"), 3).count() == 0
    assert nearest_join(table, asked, 0).count() == 0
    with pytest.raises(ValueError):
        nearest_join(table, asked, 3, "other")


def test_no_vector_passes_the_driver_and_the_plan_does_not_grow(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    plans = []
    for n in (1, 2000):
        asked = spark.range(n).select(F.col("id").alias("query_id"), F.array(*[F.lit(0.5).cast("float")] * 5).alias("vector"))
        plans.append(nearest_join(table, asked, 3)._jdf.queryExecution().executedPlan().toString())
    assert abs(len(plans[0]) - len(plans[1])) < 20 and not any("Cartesian" in plan or "NestedLoop" in plan for plan in plans)
