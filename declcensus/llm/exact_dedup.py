"""Exact deduplication by content sort.

Sampled splitters range-partition the texts, an external sort places equal texts next
to each other, and each row is compared in full with its neighbour.  All of it is
DataFrame operations: ``repartitionByRange`` samples the splitters, and a window over
the same order needs no further exchange and finds runs of equal neighbours.  The order
is by the first ``LEAD`` characters, then by a hash of the text, then by the text: the
splitters pass the driver, so they must not hold whole texts.

A text that holds more than ``1 / SPLITS`` of all rows would fill one range.  There are
fewer than ``SPLITS`` such texts, whatever the data.  Their rows get a part number, so
the splitters can fall inside them; a table of one row per such text then joins the runs.

Defined results: a null text counts as empty; a null id is smaller than any other; of
rows with equal text and equal id one stays; no rows in, no rows out; other columns of
the input are carried by :func:`keep_one` and ignored by :func:`classes`; texts of any length
are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLITS = 4096
LEAD = 64

_CLASS = "_id", "_head", "_size", "_rank", "_sha"


def _prepared(df: DataFrame, key: str, text: str, normalise, row: bool) -> DataFrame:
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    columns = [F.col(f"`{key}`").alias("_id"), (normalise(content) if normalise else content).alias("_text")]
    if row:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return df.select(*columns).withColumn("_hash", F.xxhash64("_text"))


def _frequent(rows: DataFrame) -> DataFrame | None:
    """Hashes of the texts with over ``1 / SPLITS`` of the rows, with a number of parts."""
    total = rows.count()
    found = (
        rows.groupBy("_hash").count()
        .filter((F.col("count") > 1) & (F.col("count") * SPLITS > total))
        .select("_hash", F.ceil(F.col("count") * SPLITS / F.lit(max(total, 1))).cast("int").alias("_parts"))
        .collect()
    )  # fewer than SPLITS rows
    if not found:
        return None
    values = ", ".join(f"({r._hash}L, {r._parts})" for r in found)
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(_hash, _parts)")


def _runs(rows: DataFrame, frequent: DataFrame | None, order: Column) -> DataFrame:
    """Rows with the first id, the size and the own rank of their run of equal neighbours."""
    if frequent is None:
        parted = rows.withColumn("_part", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")
        parted = rows.join(F.broadcast(frequent), "_hash", "left").withColumn("_part", F.coalesce(part, F.lit(0)))
    lead = parted.withColumn("_lead", F.substring("_text", 1, LEAD)).drop("_parts")
    ranged = lead.repartitionByRange("_lead", "_hash", "_part")
    run = W.partitionBy("_lead", "_hash", "_part", "_text")
    return ranged.select(
        *[c for c in rows.columns if c != "_hash"],
        "_part",
        F.first("_id").over(run.orderBy(order)).alias("_head"),
        F.count(F.lit(1)).over(run).alias("_size"),
        F.row_number().over(run.orderBy(order)).alias("_rank"),
    )


def _resolved(rows: DataFrame, keep: str) -> DataFrame:
    """Runs of the same text joined; adds ``_keep`` and makes ``_size`` that of the group."""
    order = F.col("_id").desc_nulls_last() if keep == "largest" else F.col("_id").asc_nulls_first()
    frequent = _frequent(rows)
    runs = _runs(rows, frequent, order).withColumn("_sha", F.sha2("_text", 256)).drop("_text")
    if frequent is None:
        return runs.withColumn("_keep", F.col("_head"))
    best = F.max if keep == "largest" else F.min
    narrow = rows.select("_id", "_text", "_hash").join(F.broadcast(frequent.select("_hash")), "_hash", "left_semi")
    joined = (
        _runs(narrow, frequent, order)
        .filter(F.col("_rank") == 1)
        .groupBy(F.sha2("_text", 256).alias("_sha"))
        .agg(best(F.struct("_head")).alias("_best"), F.sum("_size").alias("_all"))
    )  # a row per frequent text
    return (
        runs.join(F.broadcast(joined), "_sha", "left")
        .withColumn("_keep", F.when(F.col("_all").isNull(), F.col("_head")).otherwise(F.col("_best._head")))
        .withColumn("_size", F.coalesce("_all", "_size"))
    )


def _kept() -> Column:
    return (F.col("_rank") == 1) & F.col("_head").eqNullSafe(F.col("_keep"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per row of ``df``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``normalise`` maps the text column to what is compared; ``keep`` is the id that stays.
    """
    return _resolved(_prepared(df, key, text, normalise, row=False), keep).select(
        F.col("_id").alias(key),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        _kept().alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    return _resolved(_prepared(df, key, text, normalise, row=True), keep).filter(_kept()).select("_row.*")
