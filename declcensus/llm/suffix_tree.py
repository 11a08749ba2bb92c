"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of the last words.  All words of the training texts are counted; longer
sequences are counted level by level, those that occur ``LEAST`` times or more, whatever the
size of the corpus, so the tree grows with it.  A context stays if its next words diverge from
those of its longest proper suffix by more than a Bayesian penalty for its parameters:

    sum of n(sa) * ln(P(a|s) / P(a|suffix)) > ln(n(s)) / 2 * (number of next words)

Distributions are smoothed by absolute discounting: what a context discounts, and all
next words it does not list, goes to its suffix's distribution.  The root is the
smoothed word distribution, which covers all words of the corpus.

A token is a word (lower-cased A-Z, split at blanks and control blanks) or the end of a
text, which is also the context of the first word.

The tree is a table.  The log probability of a text is a sum over its sequences, of each the
step from its suffix's probability to its own and the share that it leaves to its suffix
when it is the context, so texts are scored by a join of (text, sequence, times) with the
table of these values.  Sequences that hold ``SHARE`` of all tokens, of which there are
1 / ``SHARE`` a level at most, are looked up in the tasks instead, so the join has no hot key
and fewer rows; a Bloom filter of a fixed size spares it most sequences that are not in
the tree.  Neither changes a result.  Words are dealt with likewise.

Words and sequences are known by 64-bit hashes.  Their tables are dealt to parts by the first
bits of these keys, and what a task has for a part goes there as one row of arrays: counting
and joining take a group of rows per part, not a row per sequence.  The number of parts grows
with the corpus, so a part does not.

Defined results: a null text counts as empty and has the end as its only token; without
training rows all tokens are unknown; each row of the input has a row of its own in the
output, whatever its other columns are, and repeated rows count as often as they occur;
an empty table gives no rows.  Texts of any length are scored whole, and clashing names of
carried columns do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declcensus.llm import batches as B
from declcensus.llm.tables import release, stored
from declcensus.operators.ordering import materialize

ORDER = 3
SHARE = 1e-6
WORD_SHARE = 1e-6
LEAST = 5
DISCOUNT = 0.5
END = b""
_HELD = 1 << 21
_ROUNDS = 4  # a power of two
_PART = 19  # bits of the number of tokens to a part
_BATCH_BYTES = 4 << 20
FILTER_BITS = 27


_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), 32]] = True
_BYTE = B.mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x9E3779B97F4A7C15
END_KEY = np.uint64(0x5851F42D4C957F2D)


class Words:
    """The words of some texts, found and hashed without a Python object for each.

    A word's key is a hash of its bytes.
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(self.data, np.uint8)
        blank = _BLANK[codes]
        inside = ~blank
        self.starts = np.flatnonzero(inside & np.concatenate(([True], blank[:-1])))
        self.ends = np.flatnonzero(blank & np.concatenate(([False], inside[:-1])))
        values = np.where(inside, _BYTE[codes], 0)
        self.keys = B.spans_hashed(values, self.starts, self.ends, _STEP)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(bounds, self.starts, "right")

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def word_keys(words: list[bytes]) -> np.ndarray:
    """Keys of words given one by one; ``END`` is no word and has a key of its own."""
    keys = np.full(len(words), END_KEY, np.uint64)
    real = [k for k, w in enumerate(words) if w != END]
    if real:
        keys[real] = Words([words[k] for k in real]).keys
    return keys


class Table:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]
        self.bits = np.uint64(64 - max(10, int(len(keys) * 8).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.bits)), bool)
        self.seen[self.keys >> self.bits] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``keys`` that the table has, by key, and their places in the table."""
        at = np.flatnonzero(self.seen[keys >> self.bits])
        if len(self.keys) == 0:
            return at[:0], at[:0]
        at = at[np.argsort(keys[at])]  # searched in order, neighbours are found in the same memory
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        hit = self.keys[place] == keys[at]
        return at[hit], place[hit]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        out[self.find(keys)[0]] = True
        return out


def joined(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Key of a sequence from the keys of itself without its last and without its first word."""
    return B.mix(before * np.uint64(0x9E3779B97F4A7C15) + after)


def after_of(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The other part of a joined key: what :func:`joined` does can be undone."""
    x = key ^ key >> np.uint64(31) ^ key >> np.uint64(62)
    x = x * _UNMIX[0]
    x = x ^ x >> np.uint64(27) ^ x >> np.uint64(54)
    x = x * _UNMIX[1]
    x = x ^ x >> np.uint64(30) ^ x >> np.uint64(60)
    return x - before * np.uint64(0x9E3779B97F4A7C15)


_UNMIX = [np.uint64(pow(step, -1, 1 << 64)) for step in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def packed(values: np.ndarray) -> bytes:
    """An array as bytes, the first byte of each value before the second ones: shuffles compress that better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpacked(data: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a column of :func:`packed` arrays."""
    size = np.dtype(kind).itemsize
    some = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(size, -1).T).view(kind)[:, 0] for x in data]
    return np.concatenate(some) if some else np.zeros(0, kind)


def _bits(parts: int) -> int:
    return max(4, min(24, (max(parts, 1) - 1).bit_length()))


def _dealt(bits: int, keys: np.ndarray, others: dict[str, np.ndarray], **same: object) -> Iterator[pa.RecordBatch]:
    """A row per part of the keys, which are in order: ``part``, ``same``, ``key`` and ``others``."""
    bounds = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    bounds = np.append(bounds, len(keys))
    rows: list[dict] = []
    size = 0
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        own = slice(bounds[part], bounds[part + 1])
        rows.append({"part": part, **same, "key": packed(keys[own])} | {name: packed(x[own]) for name, x in others.items()})
        size += 16 * (own.stop - own.start)
        if size > _BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, _schema(others, same))
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _schema(others, same))


def _schema(others: dict, same: dict) -> pa.Schema:
    kinds = {bool: pa.bool_(), int: pa.int64()}
    return pa.schema([("part", pa.int32()), *[(k, kinds[type(v)]) for k, v in same.items()], ("key", pa.binary()), *[(k, pa.binary()) for k in others]])


def _stream(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words; keys of END, words, END of each text; how many each has; where each word is."""
    words = Words([lowered(t) for t in texts])
    own = np.bincount(words.owner, minlength=len(texts))
    counts = own + 2
    starts = np.cumsum(counts) - counts
    place = np.arange(len(words.keys)) - np.repeat(np.cumsum(own) - own, own) + 1 + np.repeat(starts, own)
    keys = np.full(counts.sum(), END_KEY, np.uint64)
    keys[place] = words.keys
    return words, keys, counts, place


def _levels(keys: np.ndarray, counts: np.ndarray, top: int) -> Iterator[np.ndarray]:
    """For each length from 1: the key of the sequence that ends at a position, 0 where there is none."""
    within = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
    level = keys
    yield level
    for length in range(2, top + 1):
        before = np.concatenate((level[:1], level[:-1]))
        level = np.where(within >= length - 1, joined(before, level), 0)
        yield level


class Filter:
    """A Bloom filter of ``2**bits`` bits: what is not in it is surely not in the table."""

    def __init__(self, bits: int) -> None:
        self.bits, self.words = bits, np.zeros(1 << (bits - 6), np.uint64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return keys >> shift, B.mix(keys ^ np.uint64(_STEP)) >> shift

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _filter_words(it: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    own = Filter(bits)
    for batch in it:
        at = np.unique(np.concatenate(own.places(batch.column(0).to_numpy().view(np.uint64))))
        word = at >> np.uint64(6)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(at) else at.astype(np.int64)
        found = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), starts) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(word[starts].view(np.int64)), pa.array(found.view(np.int64))], names=["word", "bits"])


def filter_of(keys: DataFrame, bits: int) -> Filter:
    """The filter of a table of keys; what comes to the driver is as large as the filter at most."""
    rows = keys.mapInArrow(lambda it: _filter_words(it, bits), "word long, bits long")
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = Filter(bits)
    whole.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return whole


_DEALT = "part int, parts boolean, key binary, other binary"


def _counted(it: Iterator[pa.RecordBatch], known: Filter | None, length: int, order: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of the sequences of ``length`` + 1 words whose two parts may be known; with them, as ``parts``,
    the known sequences of ``length`` words with what they are without the last, about once per task."""
    held: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}

    def out(parts: bool) -> Iterator[pa.RecordBatch]:
        some, held[parts] = [np.concatenate(x) for x in zip(*held[parts], strict=True)], []
        if parts:
            at = np.argsort(some[0])
            keys, before = some[0][at], some[1][at]
            fresh = _fresh(keys)
            yield from _dealt(bits, keys[fresh], {"other": before[fresh]}, parts=True)
        else:
            keys = np.sort(some[0])
            at = np.flatnonzero(_fresh(keys))
            yield from _dealt(bits, keys[at], {"other": np.diff(at, append=len(keys)).astype(np.int32)}, parts=False)

    for batch in B.slices(it):
        _, keys, counts, _ = _stream(batch.column(0).to_pylist())
        start = np.zeros(len(keys), bool)
        start[np.cumsum(counts) - counts] = True
        if length == 0:
            held[False].append((keys[~start],))
        else:
            before, level = ([keys] + list(_levels(keys, counts, length)))[-2:]
            member = known.has(level) & (level != 0)
            if length > 1:
                at = np.flatnonzero(member)
                held[True].append((level[at], before[at - 1]))
            if length <= order:
                at = np.flatnonzero(member[1:] & member[:-1] & ~start[1:]) + 1
                held[False].append((joined(level[at - 1], level[at]),))
        for parts, some in held.items():
            if sum(len(x[0]) for x in some) > _HELD:
                yield from out(parts)
    for parts, some in held.items():
        if some:
            yield from out(parts)


def _fresh(keys: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before."""
    return np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))


_GATHERED = "part int, parts boolean, key binary, n binary, before binary, size long, total long"


def _gathered(dealt: pa.Table, found: pa.Table | None, least: int) -> pa.Table:
    """What all tasks have for one part: the sequences that occur ``least`` times, and the known ones with their parts."""
    rows = []

    def add(parts: bool, keys: np.ndarray, n: np.ndarray, before: np.ndarray | None) -> None:
        if len(keys):
            rows.append({
                "part": dealt.column("part")[0].as_py(), "parts": parts, "key": packed(keys), "n": packed(n),
                "before": None if before is None else packed(before), "size": len(keys), "total": int(n.sum()),
            })

    some = dealt.filter(dealt.column("parts"))
    if found is not None and len(some):
        table = Table(unpacked(found.column("key"), np.uint64), unpacked(found.column("n"), np.int64))
        keys, before = unpacked(some.column("key"), np.uint64), unpacked(some.column("other"), np.uint64)
        at, place = table.find(keys)
        fresh = _fresh(place)  # found in order
        add(True, keys[at][fresh], table.values[0][place][fresh], before[at][fresh])
    some = dealt.filter(pc.invert(dealt.column("parts")))
    keys, n = B.summed(unpacked(some.column("key"), np.uint64), unpacked(some.column("other"), np.int32).astype(np.int64))
    often = n >= least
    add(False, keys[often], n[often], None)
    return pa.Table.from_pylist(rows, _GATHERED_SCHEMA)


_GATHERED_SCHEMA = pa.schema([
    ("part", pa.int32()), ("parts", pa.bool_()), ("key", pa.binary()), ("n", pa.binary()), ("before", pa.binary()), ("size", pa.int64()), ("total", pa.int64()),
])


def _parted(dealt: pa.Table, found: pa.Table, least: int) -> pa.Table:
    return _gathered(dealt, found, least) if len(dealt) else _GATHERED_SCHEMA.empty_table()


def _listed_rows(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row per sequence that occurs ``least`` times."""
    for batch in it:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            keys, n = unpacked(row.column(0), np.uint64), unpacked(row.column(1), np.int64)
            some = n >= least
            columns = {"key": keys, "n": n}
            if batch.num_columns > 2:
                before = unpacked(row.column(2), np.uint64)
                columns |= {"before": before, "after": after_of(keys, before)}
            yield pa.RecordBatch.from_pydict({name: pa.array(x[some].view(np.int64)) for name, x in columns.items()})


def _rows(gathered: DataFrame, least: int = 1) -> DataFrame:
    """``(key, n)`` of gathered sequences."""
    return gathered.select("key", "n").mapInArrow(lambda it: _listed_rows(it, least), "key long, n long")


@dataclass
class SuffixTree:
    """``words``: log10 of the root probability of frequent words; ``often``: the values of
    frequent sequences; ``values``: the table ``(key, value)`` of the others, and its filter.
    ``word_bits`` and ``bits``: of a word's or a sequence's key, the first that name its part."""

    total: int
    distinct: int
    words: Table
    often: Table
    others: Filter
    values: DataFrame
    word_bits: int = 4
    bits: int = 4

    def room(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def _level(found: DataFrame, contexts: DataFrame, probability: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values ``(key, n, value)`` of a level's sequences and contexts, and the probability ``(key, p)``
    of its sequences at their longest state.

    ``contexts(key, n)`` has the counts of the contexts, ``probability`` that of the suffixes.
    """
    entries = materialize(
        found.join(contexts.select(F.col("key").alias("before"), F.col("n").alias("of")), "before")
        .join(probability.select(F.col("key").alias("after"), F.col("p").alias("expected")), "after")
    )
    n, of, expected = F.col("n"), F.col("of"), F.col("expected")
    sums = entries.groupBy("before").agg(
        F.max("of").alias("count"), F.sum("n").alias("seen"), F.count(F.lit(1)).alias("size"), F.sum("expected").alias("likely"),
        F.sum(n * F.log(n / of / expected)).alias("gain"),
    )
    rest, unlikely = F.greatest(F.col("count") - F.col("seen"), F.lit(0)), F.greatest(1 - F.col("likely"), F.lit(1e-12))
    gain = F.col("gain") + F.when(rest > 0, rest * F.log(rest / F.col("count") / unlikely)).otherwise(0.0)
    states = materialize(
        sums.filter(gain > 0.5 * F.log(F.greatest("count", F.lit(2)).cast("double")) * F.col("size"))
        .select("before", "count", F.log10((rest + DISCOUNT * F.col("size")) / F.col("count") / unlikely).alias("left"))
    )
    own = (n - DISCOUNT) / of
    stated = materialize(entries.join(states, "before", "left").select("key", "n", "expected", own.alias("own"), "left"))
    step = F.log10("own") - F.log10("expected") - F.col("left")
    values = stated.filter("left IS NOT NULL").select("key", "n", step.alias("value")).unionByName(
        states.select(F.col("before").alias("key"), F.col("count").alias("n"), F.col("left").alias("value"))
    )
    return values, stated.select("key", F.when(F.col("left").isNotNull(), F.col("own")).otherwise(F.col("expected")).alias("p"))


def _looked_up(rows: DataFrame) -> Table:
    """A table of bounded size for the tasks."""
    found = rows.toArrow()
    return Table(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy())


def fit(
    df: DataFrame, text: str = "text", order: int = ORDER, share: float = SHARE, word_share: float = WORD_SHARE, least: int = LEAST,
    filter_bits: int = FILTER_BITS,
) -> tuple[SuffixTree, DataFrame]:
    """The tree, and the counts of all words of the rows of ``df``, for :func:`score`."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    spark = df.sparkSession
    word_bits = _bits(int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(lambda it: _counted(it, None, 0, order, word_bits), _DEALT)
    words = materialize(dealt.groupBy("part").applyInArrow(lambda some: _gathered(some, None, 1), _GATHERED))
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(word_bits, _bits(total >> _PART))
    room = total + 0.5 * (distinct + 1)
    log = F.log10((F.col("n") + 0.5) / F.lit(room))
    base = _looked_up(_rows(words, max(1, math.ceil(total * word_share))).select("key", log))  # 1 / word_share rows at most
    known = _rows(words, least)
    probability = known.select("key", ((F.col("n") + 0.5) / F.lit(room)).alias("p"))
    parts, often = [], None
    # A pass over the texts counts the sequences of a length, and finds the parts of those that the pass before
    # has counted: the counts of all sequences are the widest table of all and go without the parts.
    for length in range(1, order + 2):
        of_known = spark.sparkContext.broadcast(filter_of(known.select("key"), filter_bits))

        def counted(it, known=of_known, length=length):
            return _counted(it, known.value, length, order, bits)

        dealt = rows.mapInArrow(counted, _DEALT)
        if often is None:
            gathered = dealt.groupBy("part").applyInArrow(lambda some: _gathered(some, None, least), _GATHERED)
        else:
            gathered = dealt.groupBy("part").cogroup(often.groupBy("part")).applyInArrow(lambda some, found: _parted(some, found, least), _GATHERED)
        gathered = materialize(gathered)
        release(spark)
        if often is not None:
            found = gathered.filter("parts").select("key", "n", "before").mapInArrow(
                lambda it: _listed_rows(it, least), "key long, n long, before long, after long"
            )
            values, probability = _level(found, contexts, probability)
            parts.append(values)
        contexts, often = known, gathered.filter("NOT parts").select("part", "key", "n")
        if often.isEmpty():
            break
        known = _rows(often, least)
    empty = spark.createDataFrame([], "key long, n long, value double")
    values = reduce(DataFrame.unionByName, parts, empty).groupBy("key").agg(F.max("n").alias("n"), F.sum("value").alias("value"))
    values = materialize(values)
    often = F.col("n") >= max(1.0, total * share)
    others = values.filter(~often).select("key", "value")
    tree = SuffixTree(
        total, distinct, base, _looked_up(values.filter(often).select("key", "value")), filter_of(others.select("key"), filter_bits), others,
        word_bits, bits,
    )
    return tree, words


def _scored(it: Iterator[pa.RecordBatch], tree: SuffixTree, order: int) -> Iterator[pa.RecordBatch]:
    """Per text: what is looked up here, and the words and sequences to join, with their counts."""
    for batch in B.slices(it):
        _, keys, counts, _ = _stream(batch.column(1).to_pylist())
        base, listed = np.zeros(len(keys)), np.zeros(len(keys), bool)
        at, place = tree.words.find(keys)
        base[at], listed[at] = tree.words.values[0][place], True
        starts = np.cumsum(counts) - counts
        lasts = starts + counts - 1
        owner = np.repeat(np.arange(len(counts)), counts)
        steps, wanted = np.zeros(len(keys)), []
        for k, level in enumerate(_levels(keys, counts, order + 1)):
            able = level != 0
            if k == 0:
                able[lasts] = False  # nothing follows the end
            at, place = tree.often.find(level)
            hit = able[at]
            steps[at[hit]] += tree.often.values[0][place[hit]]
            able[at] = False
            able &= tree.others.has(level)
            wanted.append((owner[able], level[able]))
        base[starts] = 0
        listed_count = listed.astype(np.int64)
        listed_count[starts] = 0
        listed[starts] = True  # nothing is to be looked up for the start
        rare = _listed(owner[~listed], keys[~listed], len(counts))
        own = np.add.reduceat(base, starts)
        owned, wanted = map(np.concatenate, zip(*wanted, strict=True))
        rounds = [wanted & np.uint64(_ROUNDS - 1) == r for r in range(_ROUNDS)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts - 1), pa.array(np.add.reduceat(listed_count, starts)),
             pa.array(own), pa.array(own + np.add.reduceat(steps, starts)),
             *rare, *[column for some in rounds for column in _listed(owned[some], wanted[some], len(counts))]],
            names=["row", "n_tokens", "n_known", "base_score", "score", "words", "counts", *_listed_names()],
        )


def _listed_names() -> list[str]:
    return [f"{name}{r}" for r in range(_ROUNDS) for name in ("keys", "times")]


def _listed(owner: np.ndarray, keys: np.ndarray, rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each row its distinct keys, and how often it has them."""
    order = np.argsort(keys)
    if rows < 1 << 16:
        owner = owner.astype(np.uint16)  # sorted by its digits
    order = order[np.argsort(owner[order], kind="stable")]
    owner, keys = owner[order], keys[order]
    fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[at], minlength=rows)))).astype(np.int32)
    times = np.diff(at, append=len(keys)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(keys[at].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))


def _dealt_pairs(it: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The keys of texts, dealt to parts; a batch of texts is a chunk, named by its first."""
    for batch in it:
        if batch.num_rows == 0:
            continue
        rows, lists = batch.column(0).to_numpy(), batch.column(1)
        keys, times = lists.flatten().to_numpy().view(np.uint64), batch.column(2).flatten().to_numpy()
        owner = np.repeat(rows, pc.list_value_length(lists).to_numpy())
        order = np.argsort(keys)
        yield from _dealt(bits, keys[order], {"row": owner[order], "times": times[order]}, chunk=int(rows[0]))


def _dealt_values(it: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        keys, values = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        yield from _dealt(bits, keys[order], {"value": values[order]})

    for batch in it:
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
        if sum(len(keys) for keys, _ in held) > _HELD:
            yield from out()
            held.clear()
    if held:
        yield from out()


_SUMS = "chunk long, row binary, known binary, value binary"
_SUMS_SCHEMA = pa.schema([("chunk", pa.int64()), ("row", pa.binary()), ("known", pa.binary()), ("value", pa.binary())])


def _joined(pairs: pa.Table, values: pa.Table, kind: type, of: Callable[[np.ndarray], np.ndarray] | None) -> pa.Table:
    """For each text of a part's pairs: how many of its tokens the part's table has, and the sum of the values, or of
    ``of`` the values, where keys that are not in the table count as 0."""
    table = Table(unpacked(values.column("key"), np.uint64), unpacked(values.column("value"), kind))
    out = []
    for k in range(len(pairs)):
        pair = pairs.slice(k, 1)
        keys, row, times = (unpacked(pair.column(name), t) for name, t in (("key", np.uint64), ("row", np.int64), ("times", np.int32)))
        at, place = table.find(keys)
        value, known = np.zeros(len(keys)), np.zeros(len(keys), bool)
        value[at], known[at] = table.values[0][place], True
        rows, owner = np.unique(row, return_inverse=True)
        out.append({
            "chunk": pair.column("chunk")[0].as_py(), "row": packed(rows),
            "known": packed(np.bincount(owner, times * known, len(rows)).astype(np.int64)),
            "value": packed(np.bincount(owner, times * (of(value) if of else value), len(rows))),
        })
    return pa.Table.from_pylist(out, _SUMS_SCHEMA)


def _added(sums: pa.Table) -> pa.Table:
    """The sums of a chunk's texts over all parts."""
    rows, owner = np.unique(unpacked(sums.column("row"), np.int64), return_inverse=True)
    known, value = (np.bincount(owner, unpacked(sums.column(name), t), len(rows)) for name, t in (("known", np.int64), ("value", np.float64)))
    return pa.table({"_row": rows, "known": known.astype(np.int64), "value": value})


def _summed(pairs: DataFrame, values: DataFrame, bits: int, joined: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """``(_row, known, value)`` of the texts that have keys."""
    dealt = pairs.mapInArrow(lambda it: _dealt_pairs(it, bits), "part int, chunk long, key binary, row binary, times binary")
    sums = dealt.groupBy("part").cogroup(values.groupBy("part")).applyInArrow(joined, _SUMS)
    return sums.groupBy("chunk").applyInArrow(_added, "_row long, known long, value double")


def score(df: DataFrame, tree: SuffixTree, words: DataFrame, text: str = "text", carried: tuple[str, ...] = (), order: int = ORDER) -> DataFrame:
    """Columns ``carried``, then ``n_tokens``, ``n_known``, ``base_score``, ``score``; a row per row."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(replace(tree, values=None))
    numbered = df.select(
        F.struct(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)]).alias("row"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    shape = (
        f"row {numbered.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, "
        "score double, words array<long>, counts array<int>, "
        + ", ".join(f"{name} array<{'long' if name.startswith('keys') else 'int'}>" for name in _listed_names())
    )
    own = stored(numbered.mapInArrow(lambda it: _scored(it, shared.value, order), shape))
    release(spark)
    room, bits = max(tree.room(), 1.0), tree.bits

    def logs(n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / room)

    of_words = _summed(
        own.select("row._row", "words", "counts"), words.select("part", "key", F.col("n").alias("value")), tree.word_bits,
        lambda some, found: _joined(some, found, np.int64, logs),
    )
    # The sequences of all texts are the widest join: it goes by parts of the keys, each a table of
    # one row per text, so that only one part's rows lie on the disks at once.
    added = [materialize(of_words.select("_row", "known", F.col("value").alias("log"), F.lit(0.0).alias("step")))]
    release(spark)
    for r in range(_ROUNDS):
        values = tree.values.filter(F.col("key").bitwiseAND(F.lit(_ROUNDS - 1)) == r).mapInArrow(
            lambda it: _dealt_values(it, bits), "part int, key binary, value binary"
        )
        of_sequences = _summed(
            own.select("row._row", f"keys{r}", f"times{r}"), values, bits, lambda some, found: _joined(some, found, np.float64, None)
        )
        added.append(materialize(of_sequences.select("_row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("log"), F.col("value").alias("step"))))
        release(spark)
    added = reduce(DataFrame.unionByName, added).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("known", "log", "step")])
    known, log, step = F.coalesce("known", F.lit(0)), F.coalesce("log", F.lit(0.0)), F.coalesce("step", F.lit(0.0))
    return own.drop("words", "counts", *_listed_names()).withColumn("_row", F.col("row._row")).join(added, "_row", "left").select(
        *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carried)],
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        (F.col("base_score") + log).alias("base_score"),
        (F.col("score") + log + step).alias("score"),
    )
