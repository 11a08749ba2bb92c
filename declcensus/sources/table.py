"""Source files from a table: the form that scales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus.functions import paths


def source_files(
    table: DataFrame,
    path: str = "path",
    content: str = "content",
    via_link: str | None = None,
    root: str = "",
) -> DataFrame:
    """A table with a path and a content column in the ``source_files`` layout."""
    body = F.col(content).cast("binary")
    linked = F.col(via_link) if via_link else F.lit(False)
    return table.select(
        F.col(path).alias("path"),
        body.alias("content"),
        F.length(body).cast("bigint").alias("length"),
        paths.path_depth(F.col(path), root).alias("depth"),
        linked.alias("via_link"),
        F.lit(None).cast("string").alias("io_error"),
    )


def spread(table: DataFrame) -> DataFrame:
    """Use all cores on a table that was read from files.

    Counting costs far more than scanning, and the number of splits says little: Parquet is
    read by row groups, and a split without the start of one has no rows.  So the rows of each
    split are counted, which reads no column.  A table of which no split has more than half
    of a core's share is passed on as it is, without a shuffle; any other is dealt out first.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    per_split = table.groupBy(F.spark_partition_id().alias("split")).count()
    rows, fullest = per_split.agg(F.sum("count"), F.max("count")).first()
    if not rows or 2 * cores * fullest <= rows:
        return table
    return table.repartition(max(2 * cores, table.rdd.getNumPartitions()))


def single_file(files: DataFrame, path: str) -> DataFrame:
    """The one file at ``path``; the other options do not apply to it."""
    return files.filter(F.col("path") == path)
