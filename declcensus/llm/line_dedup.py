"""Line deduplication by winnowing over line hashes.

A document is a sequence of line hashes.  Of each ``RUN`` neighbouring lines the one with
the smallest hash (the last of equals) is a fingerprint, so two texts that share a run of
that many lines share a fingerprint inside it.  Positions of fingerprints that occur more
than once are joined; each is extended both ways, as far as its fingerprint stands for
the lines, to the runs of ``RUN`` lines around it.  A run that occurred before, in an
earlier document or earlier in its own, is a repeat; repeats that touch or overlap join
into one deleted run.  The result is exact: a line goes if and only if it is in a run of
``RUN`` lines that occurred before.  With ``long_words`` a line of that many words or more
is also a fingerprint and a run of its own, whatever stands around it.

Documents are ordered by id, lines by position.  Hot lines are folded by partial
aggregation before anything is joined, and the joins have a small side Spark can repeat.

Defined results: lines end at a line feed; runs are the same if the 64-bit hashes of all their
lines are, a long line on its own by 128 bits; words of a line are split at blanks and control
blanks; a null text has no lines; an empty table gives no rows; texts of any length are read
whole, and only the named columns are, so others may have any name; texts shorter than a run
have no repeats; rows with the same id are one document
at the same place, so they are no repeat of each other; rows with a null id are left whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.llm import batches as B
from declcensus.operators.ordering import materialize

RUN = 3
LONG_WORDS = 20


def fingerprints(lines: np.ndarray, run: int) -> np.ndarray:
    """Positions that are the (last) minimum of some window of ``run`` lines."""
    if len(lines) < run:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(lines, run)[:, ::-1]
    return np.unique(np.arange(len(windows)) + run - 1 - windows.argmin(axis=1))


def _winnowed(it: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    hashes = B.WordHashes()
    for batch in B.slices(it):
        rows: tuple[list, ...] = ([], [], [], [])
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = hashes.of(text.split("\n"))
            for at in fingerprints(lines, run).tolist():
                first = max(0, at - run + 1)
                around = lines[first : at + run].view(np.int64)
                for column, value in zip(rows, (key, first, lines[at].astype(np.int64), around), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()),
             pa.array(rows[3], pa.list_(pa.int64()))],
            names=["id", "first", "fingerprint", "around"],
        )


def _long_lines(it: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(it):
        found = [
            (key, k, line)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for k, line in enumerate(x.encode("utf-8", "surrogatepass") for x in text.split("\n")) if len(line.split()) >= words
        ]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x[2]) for x in found), np.int64).reshape(-1, 2)
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(list(digests), pa.list_(pa.int64()))], names=["id", "line", "run"]
        )


def repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long_words: int | None = None
) -> DataFrame:
    """Rows ``(key, first_line, last_line)``: the runs of lines to delete, counted from 0."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).dropna()
    found = materialize(
        rows.mapInArrow(lambda it: _winnowed(it, run), "id long, first long, fingerprint long, around array<long>")
    )
    # Tables of their own, so that the joins have an exchange on either side and a hot key can be split.
    often = materialize(found.groupBy("fingerprint").count().filter("count > 1").select("fingerprint"))
    starts = F.sequence(F.lit(0), F.size("around") - run)
    runs = (
        found.join(often, "fingerprint")
        .select("id", "first", "around", F.explode(starts).alias("k"))
        .select("id", (F.col("first") + F.col("k")).alias("line"), F.slice("around", F.col("k") + 1, run).alias("run"))
        .distinct().withColumn("size", F.lit(run))
    )
    if long_words is not None:
        alone = rows.mapInArrow(lambda it: _long_lines(it, long_words), "id long, line long, run array<long>")
        runs = runs.unionByName(alone.distinct().withColumn("size", F.lit(1)))
    runs = materialize(runs)
    earliest = materialize(
        runs.groupBy("run", "size").agg(F.min(F.struct("id", "line")).alias("e"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    later = (
        runs.join(earliest.select("run", "size", "e"), ["run", "size"]).filter(F.struct("id", "line") > F.col("e"))
        .select("id", "line", (F.col("line") + F.col("size") - 1).alias("end")).distinct()
    )
    order = W.partitionBy("id").orderBy("line", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("line") > before + 1).cast("int"), F.lit(1))
    island = F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        later.withColumn("fresh", fresh).withColumn("island", island)
        .groupBy("id", "island").agg(F.min("line").alias("first_line"), F.max("end").alias("last_line"))
        .select(F.col("id").alias(key), "first_line", "last_line")
    )


def without_lines(text: Column, runs: Column) -> Column:
    """The text without the lines in ``runs``, an array of ``(first_line, last_line)``."""
    lines = F.filter(
        F.split(text, "\n", -1),
        lambda _, k: ~F.exists(runs, lambda r: (k >= r["first_line"]) & (k <= r["last_line"])),
    )
    return F.when(runs.isNull(), text).otherwise(F.array_join(lines, "\n"))


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long_words: int | None = None) -> DataFrame:
    """The rows of ``df`` with the repeated lines taken out of their text."""
    names = df.columns
    rows = df.toDF(*[f"c{k}" for k in range(len(names))])
    own, at = rows.columns[names.index(key)], rows.columns[names.index(text)]
    gone = repeats(df, key, text, run, long_words).groupBy(F.col(key).alias("id")).agg(
        F.collect_list(F.struct("first_line", "last_line")).alias("runs")  # of one document
    )
    joined = rows.join(gone, F.col(own) == F.col("id"), "left")
    return joined.select(*[without_lines(F.col(c), F.col("runs")) if c == at else F.col(c) for c in rows.columns]).toDF(*names)
