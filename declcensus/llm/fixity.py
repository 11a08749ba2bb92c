"""Merkle fixity audit of WARC archives.

A record's leaf is the SHA-256 of its bytes, at its place in the archive.  A node hashes
up to ``FANOUT`` neighbours in order, with their places and the range of offsets they
cover; a file is a whole subtree.  An audit compares the roots of two replicas and goes
down only into the branches that differ, so equal parts are settled by one comparison.

Each level is a grouped table with at most ``FANOUT`` rows a group, a sixteenth of the
level below; nothing is gathered in one place but the root.

Defined results: a record that one replica lacks differs (``missing`` or ``extra``, seen
from the first replica); two empty archives are equal; records with a null id or null
content are kept in order like others, null content as empty; repeated records have
places of their own; an empty table has no findings; records of any length are hashed whole;
only the key and the content are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.operators.ordering import materialize, with_position

FANOUT = 16
FILE_RECORDS = FANOUT**3


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC 1.1 resource record."""
    content = F.coalesce(body.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, content, F.lit("\r\n\r\n")).cast("binary")


def laid_out(records: DataFrame, *order: Column) -> DataFrame:
    """Adds ``place``, ``file``, ``offset`` in the file; ``records`` has a ``length``."""
    placed = with_position(materialize(records), *order, name="place").withColumn("place", F.col("place") - 1)
    within = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("file", F.floor(F.col("place") / FILE_RECORDS)).withColumn(
        "offset", F.coalesce(F.sum("length").over(within), F.lit(0))
    )


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Levels from ``leaves(node, start, stop, digest)`` up to the root, each checkpointed."""
    out = [leaves.select("node", "start", "stop", "digest")]
    for _ in range(levels):
        below = out[-1].withColumn("up", F.floor(F.col("node") / FANOUT))
        children = F.array_sort(F.collect_list(F.struct("node", "start", "stop", "digest")))  # FANOUT at most
        told = F.transform(children, lambda c: F.concat_ws(":", *(c[n].cast("string") for n in ("node", "start", "stop", "digest"))))
        out.append(materialize(
            below.groupBy(F.col("up").alias("node"))
            .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sha2(F.concat_ws("|", told), 256).alias("digest"))
        ))
    return out


def depth(records: int) -> int:
    levels = 0
    while FANOUT**levels < records:
        levels += 1
    return levels


def differing(one: list[DataFrame], other: list[DataFrame]) -> DataFrame:
    """``(node, finding)`` of the leaves that differ, found from the roots down."""
    branches = None
    for level in range(len(one) - 1, -1, -1):
        both = []
        for side in (one[level], other[level]):
            if branches is not None:
                side = side.withColumn("up", F.floor(F.col("node") / FANOUT)).join(branches, "up", "left_semi")
            both.append(side)
        left = both[0].select("node", F.col("digest").alias("left"))
        right = both[1].select("node", F.col("digest").alias("right"))
        found = left.join(right, "node", "full").filter(~F.col("left").eqNullSafe(F.col("right")))
        if level:
            branches = materialize(found.select(F.col("node").alias("up")))
    finding = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "extra").otherwise("changed")
    return found.select("node", finding.alias("finding"))


def audit(records: DataFrame, content: Column, replica: Callable[[Column], Column], key: str, *order: Column) -> DataFrame:
    """``(key, file, start_offset, length, finding)`` of the records whose replica is not the same.

    ``replica`` gives what a second reading of the content's bytes returns, null if nothing.
    """
    narrow = records.select(
        F.col(f"`{key}`").alias("key"), F.octet_length(content).cast("long").alias("length"),
        F.sha2(content, 256).alias("one"), F.sha2(replica(content), 256).alias("other"),
    )
    placed = materialize(laid_out(narrow, *order, F.col("one")))
    levels = depth(placed.count())
    base = F.col("place").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop")
    trees = [tree(placed.filter(F.col(c).isNotNull()).select(*base, F.col(c).alias("digest")), levels) for c in ("one", "other")]
    found = differing(*trees)
    return placed.join(found.withColumnRenamed("node", "place"), "place").select(
        F.col("key").alias(key), "file", F.col("offset").alias("start_offset"), "length", "finding"
    )
