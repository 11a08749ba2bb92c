"""Order operators: sorted output and exact global positions without one big task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.functions import paths


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow result, so that it is computed once.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
    local session without one gets a temporary folder, removed when Python ends.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's folder for checkpoints, set if it is not yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            # local-cluster has executors of its own, like any cluster.
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="declcensus-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def by_path(df: DataFrame) -> DataFrame:
    """Rows in component-wise path order: a range-partitioned sort."""
    return df.orderBy(paths.path_order(F.col("path")))


def with_position(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in the order of ``order``.

    A window without partitions would put every row into one task.  Rows are
    range-partitioned instead; each task numbers its own range, and a table of one
    row per range says how many rows come before it.  ``df`` should be narrow and
    materialized: range partitioning reads it twice.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    # One row per range: as many as there are partitions, whatever the data.
    before = ranged.groupBy("_range").count().select(
        "_range",
        F.coalesce(
            F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_before"),
    )
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_within", within)
        .join(F.broadcast(before), "_range")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_range", "_before", "_within")
    )
