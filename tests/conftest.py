import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from treelode.session import local_session, ship_package

    session = local_session(cpus=4, shuffle_partitions=4, memory="4g")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """A frame of files from a dict of path to text, with extension and category."""
    from treelode.functions.text import extension_of
    from treelode.sources.tree import category_of
    from pyspark.sql import functions as F

    def make(texts):
        rows = spark.createDataFrame(list(texts.items()), "file_path string, content string")
        rows = rows.withColumn("extension", extension_of(F.col("file_path")))
        return rows.withColumn("category", category_of(F.col("extension")))

    return make


@pytest.fixture
def tree(tmp_path):
    """Write files below a fresh root; bytes are written as they are."""

    def make(texts, root=None):
        root = root or tmp_path / "project"
        for name, text in texts.items():
            target = root / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(root)

    return make
