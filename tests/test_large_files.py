"""Files that several tasks cut, against the same files cut as one row."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from treelode.operators.chunking import chunk_headings, chunk_windows
from treelode.operators.large_files import large_sections, large_windows, numbered_lines


def texts():
    seeded = random.Random(1)
    line = lambda n: seeded.choice(["", "   ", "word " * seeded.randrange(1, 9), f"## Title {n}", "#no", "# \tOne ", "ünï 日本", "cr\r"])
    return {"src/long.sql": "\n".join(line(n) for n in range(3000)), "src/ends.md": "\n".join(line(n) for n in range(1001)) + "\n", "src/small.sql": "one\n\nthree",
            "src/exact.sql": "\n".join("x" for _ in range(200)), "src/a b+c%20.md": "# T\n" + "text\n" * 700, "src/heading.md": "# First\n\n \n## Blank\n\n# Last", "src/fifty.sql": "y\n" * 49}


@pytest.fixture(params=["300", "100000"])
def split(request, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_chunks_of_splits_equal_chunks_of_rows(spark, tree, files, split):
    given = texts()
    root = tree(given)
    lines = numbered_lines(spark, root, sorted(given))
    if split == "300":
        assert lines.where("file_path = 'src/long.sql'").select("split").distinct().count() > 20
    counts = {r.file_path: (r.n, r.most) for r in lines.groupBy("file_path").agg(F.count("*").alias("n"), F.max("total").alias("most")).collect()}
    assert counts == {path: (len(text.split("\n")),) * 2 for path, text in given.items()}
    hashes = spark.createDataFrame([(path, hashlib.sha256(text.encode()).hexdigest()) for path, text in given.items()], "file_path string, hash string")
    whole = files(given).join(hashes, "file_path")
    for large, small in ((large_windows, chunk_windows), (large_sections, chunk_headings)):
        expected = sorted(map(tuple, small(whole).collect()))
        found = large(lines, hashes).select(small(whole).columns)
        assert sorted(map(tuple, found.collect())) == expected and len(expected) > 10
