"""Tables are dealt out by where their rows are, not by how many splits there are."""

from collections import Counter

from pyspark.sql import functions as F

from declcensus.sources import table


def test_rows_in_one_of_many_splits_are_dealt_out(spark, tmp_path):
    where = str(tmp_path / "one")
    texts = F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat(F.lit("x"), "id"), 512))
    spark.range(4000).select("id", texts.alias("text")).coalesce(1).write.parquet(where)
    limits = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = spark.read.parquet(where)
        cores = spark.sparkContext.defaultParallelism
        assert found.rdd.getNumPartitions() >= cores
        rows = table.spread(found).select("id", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["id"] for r in rows) == list(range(4000))
    assert max(Counter(r["p"] for r in rows).values()) <= 4000 / cores


def test_even_splits_are_left_alone(spark):
    found = spark.range(0, 4000, 1, 2 * spark.sparkContext.defaultParallelism).select("id")
    assert table.spread(found) is found


def test_no_rows(spark):
    assert table.spread(spark.range(0)).count() == 0
