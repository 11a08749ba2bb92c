"""Importance resampling towards a target distribution, by hashed n-grams.

Separators of a text are collapsed to single spaces; an overlapped regular-expression scan
with boundary look-arounds then gives the spans of all runs of one to ``LONGEST`` words, and
the CRC-32 of a span's bytes, modulo ``BUCKETS``, is the bucket of the feature.  Both tables
are counted over all their rows.  A bucket's gain is the logarithm of its smoothed share in
the target against that in the source, in thousandths, rounded down; the sum of the gains of
a text's features is its weight.  Gumbel noise, drawn from a hash of the id, is added to the
weight, and the highest scores are a sample without replacement in proportion to the
exponential of the weights.

Each text is scanned twice, for the counts and for the weight: nothing is kept of its features,
of which there are several times as many as words.  A task sends one row per bucket at most, the
gains are ``BUCKETS`` numbers, and ranks come from range partitioning, so nothing that grows with
the rows is in one task or on the driver.

Defined results: words are runs of ASCII letters and digits (A-Z lower-cased) and of all
characters beyond ASCII; a null or empty text has no features, weight 0 and a score of noise
alone; a null id counts as an empty one in the noise; repeated rows have a row and a rank
each, and ties of score and id are broken by the row's place; an empty target gives every
bucket the same target count of 0; an empty table gives no rows.  Texts of any length are
scanned whole.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from math import floor, log
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus.llm import batches as B
from declcensus.operators.ordering import materialize, with_position

LONGEST = 3
BUCKETS = 10_000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
_SPACED = bytes(c if c > 0x7F or chr(c).isdigit() or chr(c).islower() else 0x20 for c in range(256))


class Scanner:
    """Finds the buckets of the runs of one to ``longest`` words of a text."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS) -> None:
        self.longest, self.buckets = longest, buckets
        pattern = rb"([^ ]+)"
        for _ in range(longest - 1):
            pattern = rb"(" + pattern + rb" [^ ]+)"
        # A match starts at the space before a word; its groups are the runs that start there.
        self.pattern = regex.compile(rb" " + pattern + rb"(?= )")
        self.groups = itemgetter(*range(longest, 0, -1))

    def spaced(self, text: str | None) -> bytes:
        """The words of a text between single spaces, and words that no text has behind the last."""
        lowered = (text or "").encode("utf-8", "surrogatepass").lower()
        return b" ".join([b"", *lowered.translate(_SPACED).split(), *[b"\xff"] * (self.longest - 1), b""])

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each feature."""
        runs = map(self.groups, self.pattern.finditer(self.spaced(text), overlapped=True))
        codes = np.fromiter(map(zlib.crc32, runs if self.longest == 1 else chain.from_iterable(runs)), np.uint32)
        words = len(codes) // self.longest
        real = np.add.outer(np.arange(words), np.arange(self.longest)) < words
        return words, (codes.reshape(words, self.longest)[real] % self.buckets).astype(np.int64)


def _counted(it: Iterator[pa.RecordBatch], longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    scan, counts = Scanner(longest, buckets), np.zeros(buckets, np.int64)
    for batch in B.slices(it):
        for text in batch.column(0).to_pylist():
            counts += np.bincount(scan(text)[1], minlength=buckets)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])


def bucket_counts(df: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    rows = (
        texts.mapInArrow(lambda it: _counted(it, longest, buckets), "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # one row per bucket at most
    )
    counts = np.zeros(buckets, np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the logarithm of target share over source share, rounded down."""
    above, below = int(source.sum()) + len(source), int(target.sum()) + len(target)
    pairs = zip(target.tolist(), source.tolist(), strict=True)
    return np.array([floor(1000 * log((t + 1) * above / ((s + 1) * below))) for t, s in pairs], np.int64)


def _weighed(it: Iterator[pa.RecordBatch], gain: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    scan = Scanner(longest, len(gain))
    for batch in B.slices(it):
        found = [(words, len(own), int(gain[own].sum())) for words, own in map(scan, batch.column(1).to_pylist())]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "words", "n_features", "weight"])


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((hashed.cast("double") + 0.5) / 4294967296.0)))


def resampled(
    df: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Rows ``(key, n_features, weight, score, rank)``, one per row of ``df``.

    ``percent`` of the rows with at least ``least_words`` words have a rank, from 1 on.
    """
    source, wanted = bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets)
    gain = df.sparkSession.sparkContext.broadcast(gains(source, wanted))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    weighed = rows.mapInArrow(
        lambda it: _weighed(it, gain.value, longest), "id long, words long, n_features long, weight long"
    )
    scored = materialize(
        weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id())
    )
    able = scored.filter(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    placed = with_position(able, F.desc("score"), F.asc_nulls_last("id"), F.asc("row"), name="rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank").cast("long")).alias("rank")
    named = [F.col("id").alias(key), "n_features", "weight", "score"]
    others = scored.filter(F.col("words") < least_words).select(*named, F.lit(None).cast("long").alias("rank"))
    return placed.select(*named, rank).unionByName(others)


def drawn(df: DataFrame, target: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``df`` whose id is drawn, with all their columns."""
    names = df.columns
    rows = df.toDF(*[f"c{k}" for k in range(len(names))])
    chosen = resampled(df, target, key, **parameters).filter("rank IS NOT NULL").select(F.col(key).alias("_id")).distinct()
    own = F.col(f"c{names.index(key)}")
    return rows.join(chosen, own.cast("long").eqNullSafe(F.col("_id")), "left_semi").toDF(*names)
