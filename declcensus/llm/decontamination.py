"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with up to ``length * RATE`` edits.  It is split into one
piece more than that, so an occurrence holds at least one piece unchanged.  One
automaton finds all exact piece hits in a text; around them, Myers' bit-parallel search
computes the distance.

Items are taken in blocks of about ``BLOCK`` characters, so what is sent to the tasks is
bounded however many items there are; each block is compared with every whole text.

Defined results: texts and items are compared lower-cased, with one space for each run
of characters other than letters, digits and underscores; items without any such
character match nothing, null and empty texts match nothing; equal items each match, and items
with a null id too;
repeated rows of documents are each reported; without items or documents there are no rows;
texts of any length are read whole, and other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declcensus.llm import batches as B

RATE = 1 / 16
BLOCK = 1 << 19
_WORD = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def edit_search(item: str, text: str, errors: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a part of ``text`` and where that part ends, if within ``errors``."""
    full = (1 << len(item)) - 1
    last = 1 << (len(item) - 1)
    where: dict[str, int] = {}
    for k, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << k
    up, down, distance, best = full, 0, len(item), None
    for end, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        rise = down | (full & ~(horizontal | up))
        fall = up & horizontal
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 & full
        up = (fall << 1 & full) | (full & ~(vertical | rise))
        down = rise & vertical
        if distance <= errors and (best is None or distance < best[0]):
            best = distance, end
            if distance == 0:
                break
    return best


class Matcher:
    """All items of a block; built once per task."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.ids: dict[str, list[int]] = {}
        for number, text in items:
            self.ids.setdefault(normalised(text), []).append(number)
        self.ids.pop("", None)
        self.items = list(self.ids)
        self.errors = [int(len(x) * rate) for x in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for offset, piece in pieces(item, self.errors[k]):
                found.setdefault(piece, []).append((k, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """``(item id, distance, end)`` of the best occurrence of each item in the text."""
        plain = normalised(text)
        if not self.items or not plain:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, places in self.automaton.iter(plain):
            for k, offset in places:
                start = end + 1 - offset - self.errors[k]
                stop = start + len(self.items[k]) + 2 * self.errors[k]
                own = windows.setdefault(k, [])
                # Hits come in order of their end; windows of an item start in nearly that order.
                if own and start <= own[-1][1]:
                    own[-1][0] = min(own[-1][0], start)
                    own[-1][1] = max(own[-1][1], stop)
                else:
                    own.append([start, stop])
        out = []
        for k, spans in windows.items():
            best = None
            for start, stop in spans:
                start = max(0, start)
                found = edit_search(self.items[k], plain[start:stop], self.errors[k])
                if found and (best is None or found[0] < best[0]):
                    best = found[0], start + found[1]
            if best:
                out += [(number, *best) for number in self.ids[self.items[k]]]
        return out


def _blocks(items: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[int, str]]]:
    rows = items.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).dropna(subset=["text"])
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // size))
    for k in range(blocks):
        found = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
        yield [(r["id"], r["text"]) for r in found]


def _matcher(shared: Broadcast) -> Matcher:
    return Matcher(*shared.value)


def matches(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK,
) -> DataFrame:
    """Rows ``(key, item_key, distance, match_end)``: the best occurrence of an item in a text.

    ``match_end`` counts characters of the normalised text.
    """
    rows = documents.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{key}`").alias("key"))
    shape = T.StructType([
        rows.schema["key"], T.StructField("item", T.LongType()),
        T.StructField("distance", T.IntegerType()), T.StructField("match_end", T.LongType()),
    ])
    found = None
    for part in _blocks(items, item_key, item_text, block):
        shared = rows.sparkSession.sparkContext.broadcast((part, rate))

        def matched(it: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in B.slices(it):
                hits = [(n, *m) for n, t in enumerate(batch.column(0).to_pylist()) for m in matcher.matches(t)]
                columns = list(zip(*hits, strict=True)) if hits else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(columns[0], pa.int32())), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
                    names=shape.names,
                )

        one = rows.mapInArrow(matched, shape)
        found = one if found is None else found.unionByName(one)
    return found.toDF(key, item_key, "distance", "match_end")


def uncontaminated(
    documents: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
    item_text: str = "text", rate: float = RATE, block: int = BLOCK,
) -> DataFrame:
    """The rows of ``documents`` whose text holds no item."""
    names = documents.columns
    rows = documents.toDF(*[f"c{k}" for k in range(len(names))])
    at = names.index(text)
    for part in _blocks(items, item_key, item_text, block):
        shared = rows.sparkSession.sparkContext.broadcast((part, rate))

        def clean(it: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in B.slices(it, f"c{at}"):
                yield batch.filter(pa.array([not matcher.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.toDF(*names)
