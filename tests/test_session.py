"""Session helpers."""
from pyspark.sql import functions as F

from treelode.session import settle, shared_folder, ship_package, spread


def test_spread_adds_tasks_only_where_they_are_missing(spark, tmp_path):
    spark.range(8).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(80).repartition(9).write.parquet(str(tmp_path / "many"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10, numPartitions=9)
    assert spread(wide) is wide


def test_settle_cuts_the_plan(spark):
    frame = settle(spark.range(10).where("id > 3").withColumn("x", F.col("id") * 2))
    assert frame.count() == 6 and "Filter" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_package_is_shipped_once(spark):
    ship_package(spark)
    before = set(spark.sparkContext.listFiles)
    ship_package(spark)
    assert set(spark.sparkContext.listFiles) == before and any(f.endswith("treelode.zip") for f in before)


def test_a_cluster_must_name_the_shared_folder(spark):
    assert shared_folder(spark) == shared_folder(spark)

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    import pytest
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
    Session.conf = {"spark.checkpoint.dir": "/shared/x/"}
    assert shared_folder(Session()) == "/shared/x"
