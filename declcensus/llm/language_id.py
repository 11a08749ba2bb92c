"""Language identification with a bit-sliced Bloom filter over character n-grams.

Training counts the n-grams of each language.  An n-gram belongs to a language if it
makes up at least ``share`` of that language's n-grams, so a language has at most
``1 / share`` of them, however large the corpus.  All languages share one table: a slot
holds a bit per language, and the AND of an n-gram's slots tells every language that
contains it.  A text goes to the language with the highest popcount over its n-grams,
after correction for the false positives that the fill of the language's bits implies.

Letters are lower-cased; each run of other characters is one boundary.

Defined results: a text that is null or has no letter is ``und`` with score 0; one with
letters but no known n-gram gets the language with the most training rows, score 0; ties
go to the language with more training rows, then to the first by name; without training
rows everything is ``und``.  Rows with a null language or text are not trained on; repeated
rows count as often and have a row each; an empty table gives no rows; texts of any length
are read whole; columns are carried by position, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declcensus.llm import batches as B

UNKNOWN = "und"
SIZE = 4
SHARE = 5e-5
LEAST = 0.1
SLOTS_PER_KEY = 16
_HELD = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of all texts, the number of the text each is from, and which texts have letters.

    Each text is its letters with one boundary for each run of others, and boundaries in
    front and behind, so that one letter is enough for an n-gram.
    """
    lowered = [(t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letters()[codes]
    with_letter = np.zeros(len(texts), bool)
    with_letter[owner[letter]] = True
    after = np.concatenate(([False], letter[:-1])) & ~letter
    keep = letter | after
    stream = np.where(letter, codes, 0)[keep].astype(np.uint64)
    owners = owner[keep]
    # A boundary in front of the first letter of a text, and what short texts lack behind it.
    lettered = np.flatnonzero(with_letter)
    begin = np.searchsorted(owners, lettered, "left")
    end = np.searchsorted(owners, lettered, "right")
    lacking = np.maximum(0, size - 1 - (end - begin))
    # Where one text ends and the next begins, the end comes first.
    places = np.concatenate((np.repeat(end, lacking), begin))
    stream = np.insert(stream, places, 0)
    owners = np.insert(owners, places, np.concatenate((np.repeat(lettered, lacking), lettered)))
    count = max(0, len(stream) - size + 1)
    packed = np.zeros(count, np.uint64)
    for k in range(size):
        packed = packed * np.uint64(0x100000001B3) + stream[k : k + count]
    whole = owners[:count] == owners[len(owners) - count :]
    return B.mix(packed[whole]), owners[:count][whole], with_letter


def _counted(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts = held.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())],
            names=["lang", "gram", "n"],
        )

    for batch in B.slices(rows):
        langs = batch.column(1).to_pylist()
        grams, owner, _ = _grams(batch.column(0).to_pylist(), size)
        names = sorted(set(langs))
        number = np.array([names.index(x) for x in langs])[owner] if len(owner) else owner
        for k, lang in enumerate(names):
            keys, counts = np.unique(grams[number == k], return_counts=True)
            if lang in held:
                keys, counts = B.summed(
                    np.concatenate((held[lang][0], keys)), np.concatenate((held[lang][1], counts))
                )
            held[lang] = keys, counts
            if len(keys) > _HELD:
                yield out(lang)
    for lang in list(held):
        yield out(lang)


@dataclass(frozen=True)
class LanguageFilter:
    """``tables``: slots with a bit per language, 64 languages a table; ``false``: rate of false hits."""

    languages: tuple[str, ...]
    size: int
    tables: tuple[np.ndarray, ...]
    false: np.ndarray

    def slots(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.uint64(64 - (len(self.tables[0]).bit_length() - 1))
        return grams >> bits, (grams * np.uint64(0x9E3779B97F4A7C15)) >> bits

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        grams, owner, with_letter = _grams(texts, self.size)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        one, two = self.slots(grams)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        explained = np.zeros((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            if k % 64 == 0:
                masks = self.tables[k // 64][one] & self.tables[k // 64][two]
            hit = (masks >> masks.dtype.type(k % 64)) & masks.dtype.type(1)
            hits = np.bincount(owner, weights=hit, minlength=len(texts))
            rate = np.divide(hits, total, out=np.zeros(len(texts)), where=total > 0)
            explained[k] = (rate - self.false[k]) / (1 - self.false[k])
        explained = np.clip(explained, 0, 1)
        best = explained.argmax(axis=0)
        names = [self.languages[k] if x else UNKNOWN for k, x in zip(best, with_letter, strict=True)]
        return names, np.where(with_letter, explained.max(axis=0), 0.0).tolist()


def train(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE, share: float = SHARE) -> LanguageFilter:
    """Learn from every row of ``df`` with a text and a language."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.dropna()
    counts = (
        rows.mapInArrow(lambda it: _counted(it, size), "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1 / share rows a language.
    found = (
        counts.join(totals, "lang")
        .filter(F.col("n") >= F.col("total") * share)
        .select("lang", "gram").toArrow()
    )
    ranked = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = tuple(r["lang"] for r in ranked)
    keys = found.column("gram").to_numpy().view(np.uint64)
    number = {x: k for k, x in enumerate(languages)}
    owner = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    return _filter(languages, size, keys, owner)


def _filter(languages: tuple[str, ...], size: int, keys: np.ndarray, owner: np.ndarray) -> LanguageFilter:
    slots = 1 << max(10, int(np.ceil(np.log2(max(1, len(np.unique(keys))) * SLOTS_PER_KEY))))
    kind = next(k for k, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if len(languages) <= most)
    tables = [np.zeros(slots, kind) for _ in range(max(1, -(-len(languages) // 64)))]
    empty = LanguageFilter(languages, size, tuple(tables), np.zeros(len(languages)))
    false = np.zeros(len(languages))
    for k in range(len(languages)):
        bit = kind(1) << kind(k % 64)
        for at in empty.slots(keys[owner == k]):
            tables[k // 64][at] |= bit
        false[k] = np.mean((tables[k // 64] & bit) != 0) ** 2
    return LanguageFilter(languages, size, tuple(tables), false)


def identify(df: DataFrame, model: LanguageFilter, text: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``carried`` of ``df``, then ``lang_pred`` and ``score``; a row per row of ``df``."""
    judged_text = F.col(f"`{text}`").cast("string").alias("text")
    rows = df.select(judged_text, *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)])
    shape = T.StructType(rows.schema.fields[1:] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(it):
            langs, scores = shared.value.judge(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=shape.names,
            )

    return rows.mapInArrow(judged, shape).toDF(*carried, "lang_pred", "score")


def recognised(df: DataFrame, model: LanguageFilter, text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``df`` whose text has a language that explains at least ``least`` of it."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    found = identify(plain, model, f"c{df.columns.index(text)}", tuple(plain.columns))
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*plain.columns).toDF(*df.columns)
