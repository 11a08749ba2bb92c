"""Near-duplicate classes by Order MinHash and banded alignment.

A text is its sequence of word shingles, each labelled with its occurrence number.  A
sketch takes the ``CHOSEN`` shingles with the smallest hashes and keeps them in text
order, so texts share it if they share those shingles in that order.  Texts that share
a sketch are candidates; they are verified by the longest common chain of labelled
shingles inside the band that the threshold leaves, with

    similarity = chain / (shingles of one + shingles of the other - chain)

which is the Jaccard similarity of the shingles that an alignment can match.  With 16
sketches of 3 shingles a pair at 0.8 is missed with a probability of about 1e-5.

Equal word sequences are first folded into one representative.  In a bucket of equal
sketches every representative is verified against the smallest; then the members of what
was compared with the same representative are compared with each other wherever they are
still in different classes, block against block with an inverted index.  So no link
between classes is lost, and a bucket of one class costs one alignment per member.

Defined results: words are runs of letters, digits and underscores, lower-cased; a text
with fewer words than a shingle is one shingle; texts without words are equal only if
identical, null as empty; rows with the same id are one document; rows with a null id
are classes of their own (``class_id`` null); an empty table gives no rows; texts of any
length are read whole; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus.llm import batches as B
from declcensus.llm.components import components
from declcensus.operators.ordering import materialize

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 16
CHOSEN = 3
_MEMBERS = 512
_BLOCK = 1 << 20
_CELLS = 1 << 20


def labelled_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return B.labelled(B.shingles(B.Tokens([text]).keys, words))


def order_minhash(values: np.ndarray, sketches: int = SKETCHES, chosen: int = CHOSEN) -> np.ndarray:
    """A hash per sketch of the ``chosen`` smallest values in their order; none for no values."""
    if len(values) == 0:
        return np.zeros(0, np.uint64)
    seeds = B.mix(np.arange(1, sketches + 1, dtype=np.uint64))
    chosen = min(chosen, len(values))
    at_once = max(1, _CELLS // len(values))
    out = seeds.copy()
    for s in range(0, sketches, at_once):
        own = seeds[s : s + at_once]
        ranks = (values[None, :] ^ own[:, None]) * np.uint64(0x9E3779B97F4A7C15)
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0xD6E8FEB86659FD93)
        smallest = np.sort(np.argpartition(ranks, chosen - 1, axis=1)[:, :chosen], axis=1)
        for k in range(chosen):
            out[s : s + at_once] = B.mix(out[s : s + at_once] ^ values[smallest[:, k]])
    return out


def aligned(one: np.ndarray, other: np.ndarray, threshold: float) -> float:
    """Similarity of two sequences of distinct values; 0 if it cannot reach ``threshold``."""
    both = len(one) + len(other)
    if both == 0:
        return 1.0
    needed = threshold * both / (1 + threshold)
    if min(len(one), len(other)) < needed:
        return 0.0
    _, i, j = np.intersect1d(one, other, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= both - 2 * needed
    j = j[near][np.argsort(i[near])]
    if len(j) < needed:
        return 0.0
    chain = len(j) if np.all(np.diff(j) > 0) else _increasing(j.tolist())
    return chain / (both - chain) if chain >= needed else 0.0


def _increasing(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def _sketched(it: Iterator[pa.RecordBatch], words: int, sketches: int, chosen: int) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(it):
        digests, sizes, keys = [], [], []
        texts = batch.column(1).to_pylist()
        tokens = B.Tokens(texts)
        ends = np.searchsorted(tokens.owner, np.arange(len(texts)), "right")
        for text, own in zip(texts, np.split(tokens.keys, ends[:-1]), strict=True):
            values = B.labelled(B.shingles(own, words))
            digests.append(xxhash.xxh3_128_digest(values.tobytes() if len(values) else b"-" + (text or "").encode("utf-8", "surrogatepass")))
            sizes.append(len(values))
            keys.append(order_minhash(values, sketches, chosen).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "digest", "size", "keys"],
        )


def _verified(it: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come in groups (a, part): the text of a first, then those to compare it with."""
    group, leaders = None, []
    for batch in B.slices(it):
        found = []
        for a, part, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, part) != group:
                group, leaders = (a, part), []
            values = labelled_shingles(text, words)
            if b is None:
                leaders.append(values)
            elif any(aligned(x, values, threshold) for x in leaders):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
        )


def _verify(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links among ``pairs(a, b)``.  The text of a is sent once per ``_MEMBERS`` partners."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"
    )
    leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    wanted = members.unionByName(leaders).withColumn("id", F.coalesce("b", "a"))
    rows = wanted.join(texts, "id").select("a", "part", "b", "text")
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(lambda it: _verified(it, words, threshold), "a long, b long")


def classes(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    sketches: int = SKETCHES,
    chosen: int = CHOSEN,
) -> DataFrame:
    """One row per row of ``df``: its id, ``class_id`` (smallest id of the class) and ``kept``."""
    texts = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    known = texts.filter("id IS NOT NULL")
    rows = materialize(
        known.mapInArrow(
            lambda it: _sketched(it, words, sketches, chosen),
            "id long, digest binary, size int, keys array<long>",
        )
    )
    # Tables of their own, so that the joins have an exchange on either side and a hot key can be split.
    folded = materialize(rows.groupBy("digest").agg(F.min("id").alias("rep")))
    equal = rows.select("id", "digest").join(folded, "digest").select("id", "rep")
    reps = rows.join(folded, "digest").filter("id = rep").select("rep", "size", "keys").distinct()
    banded = reps.select("rep", "size", F.explode("keys").alias("bucket"))
    first = materialize(
        banded.groupBy("bucket").agg(F.min(F.struct("rep", "size")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    buckets = materialize(banded.join(first, "bucket").select("bucket", "rep", "size", "first"))
    members = materialize(
        buckets.filter(F.col("rep") != F.col("first.rep"))
        .select(F.col("first.rep").alias("a"), F.col("first.size").alias("a_size"), F.col("rep").alias("b"), "size").distinct()
    )
    close = F.least("size", "a_size") >= threshold * F.greatest("size", "a_size")
    same = equal.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    links = materialize(_verify(members.filter(close).select("a", "b"), known, words, threshold))
    blocks = materialize(_mixed(members, materialize(components(links))))
    if not blocks.isEmpty():
        links = materialize(links.unionByName(_compare(blocks, known, words, threshold)))
    found = components(links.unionByName(same))
    return (
        texts.select("id").join(found, "id", "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("root", "id").alias("class_id"),
            F.coalesce(F.col("root") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the groups that are still in several classes, dealt to pairs of blocks.

    A group is what was compared with the same representative.  It is cut into blocks of
    about ``_BLOCK`` shingles; each member goes to every pair of blocks that has its own.
    """
    classed = members.join(found.select(F.col("id").alias("b"), "root"), "b", "left").select(
        "a", "b", "size", F.coalesce("root", "b").alias("class")
    )
    groups = (
        classed.groupBy("a")
        .agg(F.min("class").alias("least"), F.max("class").alias("most"), F.sum("size").alias("all"))
        .filter("least < most").select("a", F.ceil(F.col("all") / _BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    dealt = classed.join(groups, "a").withColumn("own", own).select(
        "a", "b", "class", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    return dealt.select("a", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "b", "class")


def _compare(blocks: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    rows = blocks.join(texts.withColumnRenamed("id", "b"), "b").select("a", "i", "j", "own", "b", "class", "text")
    dealt = rows.repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")
    return dealt.mapInArrow(lambda it: _compared(it, words, threshold), "a long, b long")


def _compared(it: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    key, held = None, []

    def out() -> pa.RecordBatch:
        found = links_between(key, held, threshold) if held else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in B.slices(it):
        for a, i, j, own, b, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, i, j) != key:
                yield out()
                key, held = (a, i, j), []
            held.append((b, group, own, labelled_shingles(text, words)))
    yield out()


def links_between(key: tuple[int, int, int], held: list, threshold: float) -> list[tuple[int, int]]:
    """Links between members of different classes; one of a pair is outside the largest class.

    Overlaps are counted with an inverted index, and only pairs that can reach the
    threshold are aligned.
    """
    values = [x[3] for x in held]
    sizes = np.array([len(v) for v in values])
    _, token = np.unique(np.concatenate(values), return_inverse=True)
    holder = np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(token, kind="stable")
    holders, ends = holder[order], np.cumsum(np.bincount(token))
    starts = np.concatenate(([0], ends[:-1]))
    shared = ends - starts > 1
    first = np.cumsum(sizes) - sizes
    names, group = np.unique([x[1] for x in held], return_inverse=True)
    blocks = np.array([x[2] for x in held])
    outside = np.flatnonzero(group != np.bincount(group).argmax())
    found = []
    for x in outside:
        own = token[first[x] : first[x] + sizes[x]]
        own = own[shared[own]]
        if len(own) < threshold * sizes[x]:
            continue
        overlap = np.bincount(np.concatenate([holders[starts[t] : ends[t]] for t in own]), minlength=len(held))
        able = overlap * (1 + threshold) >= threshold * (sizes + sizes[x])
        able &= group != group[x]
        if key[1] != key[2]:
            able &= blocks != blocks[x]
        for y in np.flatnonzero(able):
            if group[x] != group[y] and aligned(values[x], values[y], threshold):
                found.append((held[x][0], held[y][0]))
                group[group == group[x]] = group[y]
    return found


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``df`` without those of a class other than its smallest id."""
    rows = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    own = F.col(rows.columns[df.columns.index(key)])
    gone = classes(df, key, text, **parameters).filter("NOT kept").select(F.col(key).alias("id")).distinct()
    return rows.join(gone, own == F.col("id"), "left_anti").toDF(*df.columns)
