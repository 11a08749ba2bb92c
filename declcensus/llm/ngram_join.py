"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, and their components.

Documents and n-grams make a sparse incidence matrix; its product with its own transpose has
the overlaps.  The product is taken in blocks, and only for blocks that can hold a link:

1. Equal sets are folded into one row of the matrix, by a 128-bit digest.
2. Of two sets that overlap by a share t, the first |x| - ceil(t |x|) + 1 n-grams of each, in
   one order of all n-grams, have one in common.  The order puts rare n-grams first: those
   with a hash under ``KNOWN`` are counted over all sets and ordered by count and hash, then
   come the others by hash.  So columns that very many sets share are seldom among the first.
3. The columns that have the same smallest set make a group, which its sets belong to once.  The
   sets of a group are multiplied with the smallest, block by block; sizes that differ by more
   than t are never compared.
4. Groups whose sets are then still in several components are cut into bands of sizes (ratios
   beyond t are never in one block) and into blocks of about ``_BLOCK`` n-grams.  The sets outside
   of a group's largest component are multiplied with all of the band: overlaps are accumulated
   over an inverted index, and pairs below the bound that their sizes give are discarded.

Every pair that reaches t shares a column of step 2, hence a group, so it is compared or its sets
are in one component already.  No pairs are made of the members of a group; the links of a block
are a forest.  Columns are sorted over ranges, so one that very many sets share is spread.  A group
of sets that all share an n-gram, are of about one size and are nearly all unlinked takes work that
grows with the square of its size; where most are linked the work grows with what is not.

Defined results: A-Z are lower-cased, words are split at blanks and control blanks; a text
with fewer words than ``WORDS`` has its whole sequence as one n-gram; a null or empty text, or
one without words, has no n-grams and is linked with nothing; rows with the same id are one
document, with a row each; rows with a null id have a size, no links and a null component; an
empty table gives no rows.  Texts of any length are read whole.  Only the named columns are
read, so others may have any name.
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
from declcensus.llm.components import components
from declcensus.llm.suffix_tree import Words, lowered
from declcensus.llm.tables import stored
from declcensus.operators.ordering import materialize

WORDS = 3
PERCENT = 90
#: Of the 2**64 hashes, those below are counted: rather more than the first n-grams of a set need.
KNOWN = 3 << 60
_MEMBERS = 512
_BLOCK = 1 << 20


def needed(size: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The least overlap of a set of ``size`` with any that it is linked with."""
    return -(-size * percent // 100)


def ngram_sets(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of the texts, ascending in each, and how many each has."""
    found = Words([lowered(t) for t in texts])
    own = np.bincount(found.owner, minlength=len(texts))
    level, hashes, owners = found.keys, [], []
    for k in range(1, words + 1):
        if k > 1:
            level = B.mix(level[:-1] ^ B.mix(found.keys[k - 1 :] + np.uint64(k)))
        at = np.arange(len(level))
        whole = own[found.owner[at]] == k if k < words else found.owner[at] == found.owner[at + k - 1]
        first = np.concatenate(([True], found.owner[1:] != found.owner[:-1]))[at] if len(at) else at.astype(bool)
        take = whole & first if k < words else whole
        hashes.append(B.mix(level[take] + np.uint64(k)))
        owners.append(found.owner[at[take]])
    values, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        fresh = np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))
        values, owner = values[fresh], owner[fresh]
    return values, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def set_key(digest: bytes) -> int:
    """A 64-bit name of a set, by its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _sets(it: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(it):
        values, sizes = ngram_sets(batch.column(1).to_pylist(), words)
        starts = np.cumsum(sizes) - sizes
        below = np.concatenate(([0], np.cumsum(values < np.uint64(KNOWN))))
        known = below[starts + sizes] - below[starts]
        first = np.where(sizes > 0, sizes - needed(sizes, percent) + 1, 0)
        held = np.maximum(known, first)
        at = np.repeat(starts - np.cumsum(held) + held, held) + np.arange(held.sum())
        pool = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(held))).astype(np.int32), pa.array(values[at].view(np.int64)))
        digests = [_digest(values[s : s + n]) if n else None for s, n in zip(starts, sizes, strict=True)]
        keys = [d and set_key(d) for d in digests]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(known.astype(np.int64)), pool],
            names=["id", "size", "digest", "set", "known", "pool"],
        )


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those that share it with a neighbour.

    The first and the last value of a partition may go on in another, so their rows stay.
    """
    held: list[pa.RecordBatch] = []
    first = None

    def out(rows: pa.Table, last: bool) -> list[pa.RecordBatch]:
        value = rows.column(0).to_numpy()
        same = np.concatenate(([False], value[1:] == value[:-1], [False]))
        keep = same[1:] | same[:-1] | (value == first)
        if last:
            keep |= value == value[-1]
        return rows.filter(pa.array(keep)).to_batches()

    for batch in it:
        if batch.num_rows == 0:
            continue
        value = batch.column(0)
        first = value[0].as_py() if first is None else first
        if held and held[0].column(0)[0] == value[len(value) - 1]:
            held.append(batch)  # still the same value
            continue
        rows = pa.Table.from_batches([*held, batch])
        tail = int((rows.column(0).to_numpy() == value[len(value) - 1].as_py()).argmax())
        if tail:
            yield from out(rows.slice(0, tail), False)
        held = rows.slice(tail).to_batches()
    if held:
        yield from out(pa.Table.from_batches(held), True)


def _columns(named: DataFrame, percent: int) -> DataFrame:
    """Rows ``(gram, rep, set, size)``: the first n-grams of each distinct set that others share."""
    # What a digest stands for is the same in all its rows.
    own = [F.any_value(c).alias(c) for c in ("size", "set", "known", "pool")]
    sets = stored(named.filter("size > 0").groupBy("digest").agg(F.min("id").alias("rep"), *own))
    grams = sets.select(F.explode("pool").alias("gram"), "set")
    ordered = grams.repartitionByRange("gram", "set").sortWithinPartitions("gram")
    shared = materialize(ordered.mapInArrow(_shared, "gram long, set long"))
    often = materialize(shared.groupBy("gram").count().filter("count > 1"))
    counted = shared.join(often, "gram").join(sets.select("set", "rep", "size", "known"), "set")
    # Hashes under KNOWN are neither negative nor above it as signed numbers.
    low = (F.col("gram") >= 0) & (F.col("gram") < KNOWN)
    of_set = W.partitionBy("rep", "set")
    place = F.row_number().over(of_set.orderBy((~low).cast("int"), "count", "gram"))
    alone = F.col("known") - F.sum(low.cast("long")).over(of_set)
    least = F.floor((F.col("size") * percent + 99) / F.lit(100)).cast("long")  # as needed()
    return (
        counted.withColumn("place", place).withColumn("alone", alone)
        .filter(~low | (F.col("alone") + F.col("place") <= F.col("size") - least + 1))
        .select("gram", "rep", "set", "size")
    )


def _near(size: Column, other: Column, percent: int) -> Column:
    return F.least(size, other) * 100 >= F.greatest(size, other) * percent


def linked(overlap: np.ndarray, size: np.ndarray, other: np.ndarray | int, percent: int) -> np.ndarray:
    return overlap * 100 >= percent * (size + other - overlap)


def _with_leader(it: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come in groups (a, a_set, part): the leader first, then those to multiply with it."""
    group, leader = None, np.zeros(0, np.uint64)
    for batch in B.slices(it):
        names = list(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True))
        values, sizes = ngram_sets(batch.column(5).to_pylist(), words)
        starts = np.cumsum(sizes) - sizes
        found = []
        for k, (a, a_set, part, b, wanted) in enumerate(names):
            own = values[starts[k] : starts[k] + sizes[k]]
            if not len(own) or set_key(_digest(own)) != wanted:
                continue  # another text of the same document
            if (a, a_set, part) != group:
                group, leader = (a, a_set, part), np.zeros(0, np.uint64)
            if b is None:
                leader = own
            elif len(leader):
                place = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
                overlap = np.count_nonzero(leader[place] == own)
                if linked(overlap, len(own), len(leader), percent):
                    found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _leading(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among ``pairs(a, a_set, b, b_set)``; the text of a is sent once per ``_MEMBERS``."""
    parts = materialize(pairs.groupBy("a", "a_set").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("int").alias("parts")))
    members = pairs.join(parts, ["a", "a_set"]).select(
        "a", "a_set", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("id"), F.col("b_set").alias("set")
    )
    leaders = parts.select(
        "a", "a_set", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"),
        F.col("a").alias("id"), F.col("a_set").alias("set"),
    )
    rows = materialize(members.unionByName(leaders)).join(texts, "id").select("a", "a_set", "part", "b", "set", "text")
    ordered = rows.repartition("a", "a_set", "part").sortWithinPartitions("a", "a_set", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(lambda it: _with_leader(it, words, percent), "a long, b long")


def _mixed(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Rows ``(a, a_set, band, i, j, asks, class, id, set)``: of the groups that are still in several
    classes, sets of about the same size, dealt to blocks of the product.

    What is outside of a group's largest class asks (block i) all of the group (block j), so the
    work grows with the group's size times what is outside, not with the square of the size.
    """
    group = ["a", "a_set", "band"]
    classed = members.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    # A little wider than the ratio, so that rounding cannot part two sets by more than one band.
    width = float(-np.log(percent / 100)) * 1.0001
    home = F.floor(F.log(F.col("size").cast("double")) / width)
    banded = materialize(
        classed.select("a", "a_set", F.col("rep").alias("id"), "set", "size", "class", home.alias("home"))
        .withColumn("band", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    )
    sized = banded.groupBy(*group, "class").agg(F.sum("size").alias("total"), F.max("home").alias("home"))
    groups = materialize(
        sized.groupBy(*group).agg(
            F.max_by("class", F.struct("total", "class")).alias("largest"), F.max("total").alias("most"), F.sum("total").alias("total"),
            F.max("home").alias("home"),
        ).filter("most < total AND home = band")  # a group without sets of its own band is part of the one before
        .select(*group, "largest", F.ceil((F.col("total") - F.col("most")) / _BLOCK).cast("int").alias("asking"), F.ceil(F.col("total") / _BLOCK).cast("int").alias("blocks"))
    )
    dealt = banded.join(groups, group)
    own = lambda n: F.pmod(F.xxhash64("set"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = [*group, "i", "j", "asks", "class", "id", "set"]
    asking = dealt.filter("class <> largest").withColumns({"i": own("asking"), "asks": F.lit(True)}).withColumn("j", every("blocks"))
    asked = dealt.withColumns({"j": own("blocks"), "asks": F.lit(False)}).withColumn("i", every("asking"))
    return asking.select(*shown).unionByName(asked.select(*shown))


def _product(it: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    key, asking, rows = None, [], []

    def out() -> pa.RecordBatch:
        found = block_links(asking, rows, percent)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in B.slices(it):
        names = zip(*(c.to_pylist() for c in batch.columns[:9]), strict=True)
        values, sizes = ngram_sets(batch.column(9).to_pylist(), words)
        ends = np.cumsum(sizes)
        for k, (*block, asks, group, name, wanted) in enumerate(names):
            if block != key:
                yield out()
                key, asking, rows = block, [], []
            grams = values[ends[k] - sizes[k] : ends[k]]
            if len(grams) and set_key(_digest(grams)) == wanted:
                (asking if asks else rows).append((name, group, grams))
    yield out()


def block_links(asking: list[tuple[int, int, np.ndarray]], rows: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between sets ``(name, class, n-grams)`` of different classes, one of each pair asking.

    The product of an asking row with the block is accumulated over an inverted index.
    """
    if not asking or not rows:
        return []
    sizes = np.array([len(x[2]) for x in rows])
    grams, column = np.unique(np.concatenate([x[2] for x in rows]), return_inverse=True)
    order = np.argsort(column, kind="stable")
    holders = np.repeat(np.arange(len(rows)), sizes)[order]
    ends = np.cumsum(np.bincount(column))
    starts = np.concatenate(([0], ends[:-1]))
    _, group = np.unique([x[1] for x in rows + asking], return_inverse=True)
    found = []
    for x, (name, _, own) in enumerate(asking, len(rows)):
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        at = place[grams[place] == own]
        if len(at) < needed(len(own), percent):
            continue
        lengths = ends[at] - starts[at]
        held = np.repeat(starts[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        overlap = np.bincount(holders[held], minlength=len(rows))
        for y in np.flatnonzero(linked(overlap, sizes, len(own), percent) & (group[: len(rows)] != group[x])):
            if group[x] != group[y]:
                found.append((name, rows[y][0]))
                group[group == group[x]] = group[y]
    return found


def joined(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows ``(key, n_shingles, component_id)``: the size of each set, and the smallest id reachable."""
    texts = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = stored(
        texts.mapInArrow(
            lambda it: _sets(it, words, percent), "id long, size long, digest binary, set long, known long, pool array<long>"
        )
    )
    named = rows.filter("id IS NOT NULL")
    # Tables of their own, so that the joins have an exchange on either side and a hot key can be split.
    columns = materialize(_columns(named, percent))
    small = F.min(F.struct("size", "rep", "set")).alias("first")
    leaders = materialize(columns.groupBy("gram").agg(small, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    members = materialize(
        columns.join(leaders, "gram").select(
            F.col("first.rep").alias("a"), F.col("first.set").alias("a_set"), F.col("first.size").alias("a_size"), "rep", "set", "size"
        ).distinct()
    )
    near = (F.col("set") != F.col("a_set")) & _near(F.col("size"), F.col("a_size"), percent)
    pairs = members.filter(near).select("a", "a_set", F.col("rep").alias("b"), F.col("set").alias("b_set"))
    wanted = materialize(members.select(F.col("rep").alias("id")).distinct())
    held = texts.join(wanted, "id", "left_semi")
    if not named.groupBy("id").count().filter("count > 1").isEmpty():
        held = held.distinct()
    held = stored(held)
    links = materialize(_leading(pairs, held, words, percent))
    blocks = materialize(_mixed(members, materialize(components(links)), percent))
    if not blocks.isEmpty():
        block = ["a", "a_set", "band", "i", "j"]
        dealt = blocks.join(held, "id").select(*block, "asks", "class", "id", "set", "text")
        ordered = dealt.repartition(*block).sortWithinPartitions(*block)
        links = materialize(links.unionByName(ordered.mapInArrow(lambda it: _product(it, words, percent), "a long, b long")))
    folded = materialize(named.filter("size > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    equal = named.select("id", "digest").join(folded, "digest").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    found = materialize(components(links.unionByName(equal)))
    return (
        rows.select("id", "size").join(found, "id", "left")
        .select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    )
