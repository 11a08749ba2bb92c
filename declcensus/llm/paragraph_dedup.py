"""Substring deduplication by paragraph MinHash banding.

Paragraphs are whole lines, and pieces of lines, cut where a smallest hash of two
neighbouring words in a window of ``WINDOW`` words falls.  The cuts depend on the words
around them only, so a passage of more than twice the window that was pasted anywhere is
cut the same way inside.  Paragraphs under ``LEAST_WORDS`` words say too little and are
passed over.  Pieces of a pasted passage can be short, so runs of ``PASSAGE`` words at
winnowed places are paragraphs too, which are the same only if all words are: any passage
of ``SPAN`` words or more holds one of them, whatever stands around it.

Equal paragraphs are folded by a digest.  Distinct ones get a MinHash per band over their
five-word shingles; :func:`bands` finds the number of bands for a wanted recall at the
threshold.  Paragraphs that collide in a band and are of about one size are compared in full
(Jaccard similarity of labelled shingles, in order), block against block with an inverted
index, so no link is lost and no task gets an unbounded group.  Connected components of the links are the
classes; the first occurrence of a class, by id and position, stays and the others go.
A line and its pieces are classed on their own, so places can overlap; what overlaps the
occurrence that stays is part of it and stays too.

Classes within a single document are left alone: line deduplication is for those.  A
repeat is reported where repeated paragraphs follow each other, with at most
``LEAST_WORDS`` other words between two, over ``REPORT_WORDS`` words or more in all.

Defined results: words are runs of letters, digits and underscores, lower-cased; null and
empty texts have no paragraphs; rows with the same id are one document; rows with a null
id are left whole; an empty table gives no rows; texts of any length are read whole; only the
named columns are read, and :func:`cleaned` carries others by position, so names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from declcensus.llm import batches as B
from declcensus.llm.components import components
from declcensus.llm.near_dedup import aligned, links_between
from declcensus.llm.tables import release, stored
from declcensus.operators.ordering import materialize

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99
WINDOW = 24
LEAST_WORDS = 6
REPORT_WORDS = 20
PASSAGE = 20
SPAN = 51
_WORD = re.compile(r"\w+")
_BLOCK = 1 << 20
_FEW = 4
_SAMPLED, _MANY, _PIECES = 1 / 32, 4096, 256


def bands(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Bands of one MinHash each, so that a pair at the threshold collides with that chance."""
    return max(1, ceil(log(1 - recall) / log(1 - threshold)))


class Paragraphs:
    """The paragraphs of some texts: the text of each, its first word and its number of words.

    ``keys`` are the words of all texts, ``at`` the place of a paragraph among them;
    ``exact`` marks the runs that are compared as a whole.
    """

    def __init__(self, texts: list[str | None]) -> None:
        tokens = B.Tokens(texts)
        self.keys, owner, self.tokens = tokens.keys, tokens.owner, tokens
        lines = np.flatnonzero(tokens.fresh)
        cut = tokens.fresh
        count = len(self.keys)
        if count > WINDOW:
            pairs = B.mix(self.keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.keys[1:])
            cut[B.winnowed(pairs, WINDOW, owner[:-WINDOW] == owner[WINDOW:]) + 1] = True
        pieces = np.flatnonzero(cut)
        whole = np.diff(np.searchsorted(pieces, lines), append=len(pieces)) > 1  # an uncut line is a piece
        runs = self._runs(owner)
        sizes = np.diff(pieces, append=count), np.diff(lines, append=count)[whole], np.full(len(runs), PASSAGE)
        starts, sizes = np.concatenate((pieces, lines[whole], runs)), np.concatenate(sizes)
        exact = np.arange(len(starts)) >= len(starts) - len(runs)
        order = np.lexsort((exact, -sizes, starts))
        order = order[sizes[order] >= LEAST_WORDS]
        self.at, self.words, self.exact = starts[order], sizes[order], exact[order]
        self.owner = owner[self.at]
        own = np.searchsorted(owner, np.arange(len(texts)))
        self.first = self.at - own[self.owner]
        self.digests = B.digests(self.keys, self.at, self.at + self.words)
        self.digests[self.exact] = B.mix(~self.digests[self.exact])

    def _runs(self, owner: np.ndarray) -> np.ndarray:
        """Where a run of ``PASSAGE`` words has the smallest hash of those in ``SPAN`` words of a text."""
        if len(self.keys) < SPAN:
            return np.zeros(0, np.int64)
        at = np.arange(len(self.keys) - PASSAGE + 1)
        runs = B.digests(self.keys, at, at + PASSAGE)
        return B.winnowed(runs, SPAN - PASSAGE + 1, owner[: len(owner) - SPAN + 1] == owner[SPAN - 1 :])

    def shingles(self, k: int) -> np.ndarray:
        if self.exact[k]:
            return self.digests[k : k + 1]
        return B.labelled(B.shingles(self.keys[self.at[k] : self.at[k] + self.words[k]], WORDS))

    def plain(self, k: int) -> str:
        """The paragraph in lower case, with what stands between its words."""
        return self.tokens.lowered[self.tokens.starts[self.at[k]] : self.tokens.ends[self.at[k] + self.words[k] - 1]]

    def minima(self, seeds: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
        """For each seed the smallest hash among the shingles of each paragraph, or of the chosen ones."""
        chosen = np.arange(len(self.at)) if chosen is None else chosen
        if len(chosen) == 0:
            return np.zeros((len(seeds), 0), np.uint64)
        shingles = B.shingles(self.keys, WORDS)
        at = self.at[chosen]
        spans = np.stack((at, at + self.words[chosen] - WORDS + 1), axis=1).ravel()
        shingles = np.concatenate((shingles, shingles[-1:]))  # so that every end is a place
        return np.stack([B.mix(np.minimum.reduceat(B.mix(shingles ^ s), spans)[::2] ^ s) for s in seeds])


def _banded(it: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    """``(band, digest, words)`` of the paragraphs that are compared, each once per slice."""
    seeds = B.mix(np.arange(1, count + 1, dtype=np.uint64))
    for batch in B.slices(it, "text"):
        found = Paragraphs(batch.column(0).to_pylist())
        if len(found.at):
            at = np.sort(np.unique(found.digests, return_index=True)[1])
            at = at[~found.exact[at]]
            bands = found.minima(seeds, at).ravel().view(np.int64)
            digests, words = (np.tile(c[at], count) for c in (found.digests.view(np.int64), found.words.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(bands), pa.array(digests), pa.array(words)], names=["band", "digest", "words"])


def _placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.slices(it):
        found = Paragraphs(batch.column(1).to_pylist())
        columns = [found.digests.view(np.int64), found.first.astype(np.int32), found.words.astype(np.int32), found.exact]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(found.owner)), *map(pa.array, columns)], names=["id", "digest", "first", "words", "exact"]
        )


def _taken(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted paragraphs of each text, once for each group they are wanted in."""
    for batch in B.slices(it, "text"):
        found = Paragraphs(batch.column(0).to_pylist())
        own = found.digests.view(np.int64)
        some = np.flatnonzero(np.isin(own, batch.column(1).flatten().field("digest").to_numpy()))
        at = dict(zip(zip(found.owner[some].tolist(), own[some].tolist(), strict=True), some.tolist(), strict=True))
        groups, bands, digests, values = [], [], [], []
        for n, wanted in enumerate(batch.column(1).to_pylist()):
            for w in wanted:
                k = at.get((n, w["digest"]))
                if k is not None:
                    groups.append(w["a"])
                    bands.append(w["size"])
                    digests.append(w["digest"])
                    values.append(found.plain(k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(groups, pa.int64()), pa.array(bands, pa.int64()), pa.array(digests, pa.int64()), pa.array(values, pa.string())],
            names=["a", "size", "digest", "text"],
        )


def _neighbours(it: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(a, digest, words, band, edge)`` of rows sorted by band that share it with another digest.

    ``a`` is the first digest of the band in this partition.  The ``hot`` bands may go on in
    another; their rows are marked.
    """
    names = ["a", "digest", "words", "band", "edge"]
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        band, digest = rows[:2]
        once = np.concatenate(([True], (band[1:] != band[:-1]) | (digest[1:] != digest[:-1]))) if len(band) else np.zeros(0, bool)
        band, digest, words = (c[once] for c in rows)
        starts = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1]))) if len(band) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(band))
        edge = np.repeat(np.isin(band[starts], hot), sizes)
        keep = (np.repeat(sizes, sizes) > 1) | edge
        leader = np.repeat(digest[starts], sizes)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (leader, digest, words, band, edge)], names=names)

    for batch in it:
        held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
        band = held[0]
        if len(band) == 0:
            continue
        whole = int(np.flatnonzero(band != band[-1])[-1]) + 1 if band[0] != band[-1] else 0
        if whole:
            yield out([h[:whole] for h in held])
            held = [h[whole:] for h in held]
    yield out(held)


def _hot(banded: DataFrame) -> list[int]:
    """The bands with more than a fixed share of the rows of a sample, so of a bounded number."""
    counts = materialize(banded.groupBy("band").count())
    least = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] / _MANY
    return [r.band for r in counts.filter(F.col("count") > max(least, 4)).select("band").collect()]


def _colliding(banded: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """``(a, digest, words)`` of the paragraphs that share a band; ``a`` names the group.

    A band that very many of the ``sampled`` rows (all, if not given) share is cut into pieces by its digests, which
    get one name from a table of these bands.  The sample decides where rows go, never what is found.
    """
    hot = _hot(banded if sampled is None else sampled)
    piece = F.when(F.col("band").isin(hot), F.pmod("digest", F.lit(_PIECES))).otherwise(F.lit(0)) if hot else F.lit(0)
    ordered = banded.repartition("band", piece).sortWithinPartitions("band", "digest")
    marked = np.array(hot, np.int64)
    found = materialize(ordered.mapInArrow(lambda it: _neighbours(it, marked), "a long, digest long, words int, band long, edge boolean"))
    edges = found.filter("edge").groupBy("band").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).filter("one < other")
    named = found.filter("edge").join(edges, "band").select(F.col("one").alias("a"), "digest", "words")
    return found.filter("NOT edge").select("a", "digest", "words").unionByName(named).distinct()


def _of_one_size(colliding: DataFrame, threshold: float) -> DataFrame:
    """``(a, size, digest, words)``: the groups cut into bands of sizes, and what is alone in one left out.

    Two paragraphs whose numbers of shingles differ by more than the threshold cannot be near.
    Each is in its own band of sizes and the next, so two that can be near share one.
    """
    # A little wider than the ratio, so that rounding cannot part two paragraphs by more than one band.
    home = F.floor(F.log((F.col("words") - WORDS + 1).cast("double")) / (-log(threshold) * 1.0001))
    sized = colliding.withColumn("home", home).withColumn("size", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    # A band without paragraphs of its own has the same as the one before.
    groups = sized.groupBy("a", "size").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).filter("n > 1 AND home = size")
    return sized.drop("home").join(materialize(groups.select("a", "size")), ["a", "size"])


def _pairs(key: tuple, held: list, threshold: float) -> list[tuple[int, int]]:
    """What ``links_between`` finds, for a few paragraphs, which need no index."""
    return _all_pairs([(key, held)], threshold)


def _all_pairs(blocks: list[tuple[tuple, list]], threshold: float) -> list[tuple[int, int]]:
    """The links of many groups of a few paragraphs, compared all at once."""
    sides = [
        (held[x], held[y], n, x, y) for n, (key, held) in enumerate(blocks) for y in range(len(held)) for x in range(y)
        if key[1] == key[2] or held[x][2] != held[y][2]
    ]
    able = _all_aligned([s[0][3] for s in sides], [s[1][3] for s in sides], threshold)
    found, groups = [], {}
    for k in np.flatnonzero(able):
        one, other, n, x, y = sides[k]
        group = groups.setdefault(n, list(range(_FEW)))
        if group[x] != group[y]:
            found.append((one[0], other[0]))
            groups[n] = [group[y] if g == group[x] else g for g in group]
    return found


def _all_aligned(ones: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each pair of sequences whether ``aligned`` finds it similar enough."""
    sizes = np.array([[len(v) for v in side] for side in (ones, others)]).reshape(2, -1)
    both = sizes.sum(axis=0)
    needed = threshold * both / (1 + threshold)
    able = sizes.min(axis=0, initial=np.iinfo(np.int64).max) >= needed
    chosen = np.flatnonzero(able)
    if len(chosen) == 0:
        return able
    own = np.repeat(np.tile(np.arange(len(chosen)), 2), sizes[:, chosen].ravel())
    values = np.concatenate([side[k] for side in (ones, others) for k in chosen])
    lengths = sizes[:, chosen].ravel()
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.lexsort((values, own))  # stable: of two equal values the first sequence's comes first
    shared = np.flatnonzero((values[order[1:]] == values[order[:-1]]) & (own[order[1:]] == own[order[:-1]]))
    i, j, pair = place[order[shared]], place[order[shared + 1]], own[order[shared]]
    near = np.abs(i - j) <= (both - 2 * needed)[chosen][pair]
    i, j, pair = i[near], j[near], pair[near]
    counts = np.bincount(pair, minlength=len(chosen))
    enough = counts >= needed[chosen]
    order = np.lexsort((i, pair))
    j, pair = j[order], pair[order]
    turns = (j[1:] <= j[:-1]) & (pair[1:] == pair[:-1])
    for k in np.unique(pair[1:][turns]).tolist():  # not all in order
        if enough[k]:
            enough[k] = bool(aligned(ones[chosen[k]], others[chosen[k]], threshold))
    able[chosen] = enough
    return able


def _compared(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    key, held, few = None, {}, []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in B.slices(it):
        names = zip(*(c.to_pylist() for c in batch.columns[:6]), strict=True)
        for (a, size, i, j, own, digest), shingles in zip(names, _shingles(batch.column(6).to_pylist()), strict=True):
            if ((a, size), i, j) != key:
                if len(held) > _FEW:
                    yield out(links_between(key, list(held.values()), threshold))
                elif len(held) > 1:
                    few.append((key, list(held.values())))
                key, held = ((a, size), i, j), {}
            held[digest] = digest, digest, own, shingles
        yield out(_all_pairs(few, threshold))
        few = []
    if len(held) > _FEW:
        yield out(links_between(key, list(held.values()), threshold))
    elif len(held) > 1:
        yield out(_pairs(key, list(held.values()), threshold))


def _shingles(paragraphs: list[str]) -> list[np.ndarray]:
    """The labelled shingles of paragraphs of ``LEAST_WORDS`` words or more."""
    tokens = B.Tokens(paragraphs)
    counts = np.bincount(tokens.owner, minlength=len(paragraphs))
    sizes = counts - WORDS + 1
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(np.cumsum(counts) - counts - ends + sizes, sizes)
    return np.split(B.labelled_each(B.shingles(tokens.keys, WORDS)[at], sizes), ends[:-1])


def _links(colliding: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links among the paragraphs ``(a, size, digest, words, id)`` of the same group and band of sizes."""
    sizes = materialize(colliding.groupBy("a", "size").agg(F.ceil(F.sum("words") / _BLOCK).cast("int").alias("blocks")))
    wanted = colliding.groupBy("id").agg(F.collect_list(F.struct("a", "size", "digest")).alias("wanted"))  # of one document
    taken = wanted.join(texts, "id").select("text", "wanted").mapInArrow(_taken, "a long, size long, digest long, text string")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = taken.join(sizes, ["a", "size"]).withColumn("own", own).select(
        "a", "size", "digest", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("a", "size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "digest", "text")
    ordered = dealt.repartition("a", "size", "i", "j").sortWithinPartitions("a", "size", "i", "j")
    return ordered.mapInArrow(lambda it: _compared(it, threshold), "a long, b long")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Repeated paragraphs: ``(key, first_word, words, class_id, keep_<key>, removed)``.

    Places count words from 0 and can overlap: a line, its pieces and the runs in it are
    paragraphs of their own.  The one that stays of each class is there too, not removed.
    """
    texts = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).dropna()
    spark, count = df.sparkSession, bands(threshold, recall)
    everywhere = stored(texts.mapInArrow(_placed, "id long, digest long, first int, words int, exact boolean"))
    # Bands before anything wide: what is alone in its bands, or of a size of its own, is not looked at again.
    # Tables of their own, so that the joins have an exchange on either side and a hot key can be split.
    banded = texts.select("text").mapInArrow(lambda it: _banded(it, count), "band long, digest long, words int")
    some = texts.select("text").sample(_SAMPLED, seed=1).mapInArrow(lambda it: _banded(it, count), "band long, digest long, words int")
    near = materialize(_of_one_size(materialize(_colliding(banded, some)), threshold))
    release(spark)
    first = everywhere.filter("NOT exact").join(near.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("id").alias("id"))
    links = materialize(_links(near.join(materialize(first), "digest"), texts, threshold))
    release(spark)
    roots = materialize(components(links))
    equal = everywhere.groupBy("digest").count().filter("count > 1").select("digest")
    classes = materialize(
        roots.select(F.col("id").alias("digest"), "root").join(materialize(equal), "digest", "full")
        .select("digest", F.coalesce("root", "digest").alias("class_id"))
    )
    release(spark)
    words, at = F.col("words").cast("long").alias("words"), F.col("first").cast("long").alias("first")
    placed = materialize(everywhere.join(classes, "digest").select("id", at, words, "class_id"))
    release(spark)
    across = materialize(
        placed.groupBy("class_id").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        .filter("least < most").select("class_id")
    )
    members = materialize(placed.join(across, "class_id").transform(_long_enough))
    place = F.struct("id", "first", (-F.col("words")).alias("less"))  # of two at one place the longer
    keeper = materialize(members.groupBy("class_id").agg(F.min(place).alias("keeper")))
    stays = (F.col("id") == F.col("keeper.id")) & (F.col("first") < F.col("keeper.first") - F.col("keeper.less"))
    return members.join(keeper, "class_id").select(
        F.col("id").alias(key), F.col("first").alias("first_word"), "words", "class_id",
        F.col("keeper.id").alias(f"keep_{key}"), (~stays).alias("removed"),
    )


def _long_enough(found: DataFrame) -> DataFrame:
    """The paragraphs in stretches of at least ``REPORT_WORDS`` repeated words."""
    order = W.partitionBy("id").orderBy("first", F.desc("words"))
    end = F.col("first") + F.col("words")
    ended = found.withColumn("ended", F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1)))
    fresh = ended.withColumn("fresh", F.when(F.col("first") - F.col("ended") <= LEAST_WORDS, 0).otherwise(1))
    stretch = fresh.withColumn("stretch", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    added = F.greatest(end - F.greatest("first", F.coalesce("ended", "first")), F.lit(0))  # words counted once
    total = F.sum(added).over(W.partitionBy("id", "stretch"))
    return stretch.withColumn("total", total).filter(F.col("total") >= REPORT_WORDS).drop("ended", "fresh", "stretch", "total")


def cleaned(df: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``df`` without the words of removed paragraphs and what stands between them."""
    gone = repeats(df, key, text, **parameters).filter("removed").groupBy(F.col(key).alias("_id")).agg(
        F.collect_list(F.struct("first_word", "words")).alias("_gone")  # of one document
    )
    names = df.columns
    at = names.index(text)
    rows = df.toDF(*[f"c{k}" for k in range(len(names))]).join(gone, F.col(f"c{names.index(key)}") == F.col("_id"), "left").drop("_id")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [_without(t, g) for t, g in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(names)])

    return rows.mapInArrow(cut, rows.drop("_gone").schema).toDF(*names)


def _without(text: str | None, gone: list | None) -> str | None:
    if not text or not gone:
        return text
    spans = [m.span() for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for g in sorted(gone, key=lambda g: g["first_word"]):
        out.append(text[last : max(last, spans[g["first_word"]][0])])
        last = max(last, spans[g["first_word"] + g["words"] - 1][1])
    return "".join([*out, text[last:]])
