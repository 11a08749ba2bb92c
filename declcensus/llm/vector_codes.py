"""Vector codes by product quantization, trained by Lloyd rounds over cover trees.

Components are scaled to integers and a vector is cut into ``PARTS`` equal parts, each coded
by the nearest entry of its part's codebook.  Vectors are dealt to blocks inside their own
partitions.  For each part of a block a cover tree is built once: a node's points lie within
its radius of its first point, and its children's first points are more than half the radius
apart.  Points are kept in tree order, so a subtree is a range of them, and its sum is a
difference of cumulative sums.

A round goes down each tree from the root.  With d the distance from a node's first point to
its nearest entry and r the node's radius, only entries within d + 2r can be nearest to any
point below (triangle inequality).  Where a single one is left the whole subtree is assigned,
by its cumulative sum; other nodes hand the entries that are left to their children, and the
points of a leaf are compared exactly, in integers, ties to the lower index.  So the result is
that of plain comparison.  A task sends a sum and a count per component of the codebooks.

Defined results: vectors that are null or empty, hold nulls or non-finite components, cannot
be cut into equal parts, or have another length than that of the smallest id are left out;
scaled components are held within 2**28, so sums of squares are exact in 64 bits; with fewer
vectors than entries the codebooks are that much smaller; null ids come last and are coded
like others; of rows with the same id the smaller vector comes first; repeated rows have a row
each; an empty table gives no rows.  Trees save most where parts have few dimensions.  Only
the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declcensus.llm.tables import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 4096
LEAF = 16
_MOST = 1 << 28
_CELLS = 1 << 22
_NODES = ["starts", "ends", "firsts", "children"]


@dataclass
class CoverTree:
    """``points`` in tree order, ``order`` their places before; nodes come level by level, and
    the children of a node are next to each other."""

    points: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    children: np.ndarray
    radii: np.ndarray


def _away(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - one) ** 2).sum(axis=1).astype(float))


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> CoverTree:
    order = np.arange(len(points))
    starts, ends, firsts, children, radii = [0], [len(points)], [], [], []
    node = 0
    while node < len(starts):
        start, end = starts[node], ends[node]
        own = order[start:end]
        away = _away(points[own], points[own[0]])
        radius = away.max()
        radii.append(radius)
        groups = []
        if end - start > leaf and radius > 0:
            near = away <= radius / 2
            while True:
                groups.append(own[near])
                own = own[~near]
                if len(own) == 0:
                    break
                near = _away(points[own], points[own[0]]) <= radius / 2
            order[start:end] = np.concatenate(groups)
        firsts.append(len(starts))
        children.append(len(groups))
        bounds = start + np.cumsum([0, *map(len, groups)])
        starts.extend(bounds[:-1].tolist())
        ends.extend(bounds[1:].tolist())
        node += 1
    shape = [np.array(x, np.int64) for x in (starts, ends, firsts, children)]
    return CoverTree(points[order], order, *shape, np.array(radii))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def assign(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point in tree order, and the sums and counts by entry."""
    codes = np.zeros(len(tree.points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    cumulative = np.concatenate((np.zeros((1, entries.shape[1]), np.int64), np.cumsum(tree.points, axis=0)))
    nodes, able = np.array([0]), np.ones((1, len(entries)), bool)
    while len(nodes):
        first = tree.points[tree.starts[nodes]]
        away = np.sqrt(((first[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2).astype(float))
        away[~able] = np.inf
        nearest = away.min(axis=1)
        within = (nearest + 2 * tree.radii[nodes]) * (1 + 1e-9) + 1e-9  # more than the rounding of the roots
        able = away <= within[:, None]
        single = able.sum(axis=1) == 1
        best = able.argmax(axis=1)
        start, end = tree.starts[nodes], tree.ends[nodes]
        codes[_spread(start[single], (end - start)[single])] = np.repeat(best[single], (end - start)[single])
        np.add.at(sums, best[single], cumulative[end[single]] - cumulative[start[single]])
        np.add.at(counts, best[single], (end - start)[single])
        inner = tree.children[nodes] > 0
        last = np.flatnonzero(~single & ~inner)
        at = _spread(start[last], (end - start)[last])
        owner = np.repeat(last, (end - start)[last])
        for k in range(0, len(at), max(1, _CELLS // entries.size)):
            some = at[k : k + max(1, _CELLS // entries.size)]
            square = ((tree.points[some][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
            square[~able[owner[k : k + len(some)]]] = np.iinfo(np.int64).max
            codes[some] = square.argmin(axis=1)
            np.add.at(sums, codes[some], tree.points[some])
            np.add.at(counts, codes[some], 1)
        down = np.flatnonzero(~single & inner)
        sizes = tree.children[nodes[down]]
        able = np.repeat(able[down], sizes, axis=0)
        nodes = _spread(tree.firsts[nodes[down]], sizes)
    return codes, sums, counts


def usable(vector: Column, parts: int) -> Column:
    """Whether a vector can be coded."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & ~bad, F.lit(False))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(float) * scale), -_MOST, _MOST).astype(np.int64)


def _planted(it: Iterator[pa.RecordBatch], parts: int, scale: int) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for start in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(start, BLOCK)
            points = scaled(batch.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(batch.num_rows, parts, -1)
            trees = [cover_tree(points[:, p]) for p in range(parts)]
            nested = lambda name, kind: pa.array([[getattr(t, name).ravel() for t in trees]], pa.list_(pa.list_(kind)))  # noqa: B023, E731
            rows = pa.ListArray.from_arrays(np.array([0, batch.num_rows], np.int32), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [rows, *(nested(x, pa.int32()) for x in ("points", "order", *_NODES)), nested("radii", pa.float64())],
                names=["rows", "points", "order", *_NODES, "radii"],
            )


def _trees(batch: pa.RecordBatch, k: int, dimensions: int) -> Iterator[CoverTree]:
    row = {n: batch.column(batch.schema.get_field_index(n))[k].values for n in ("points", "order", *_NODES, "radii")}
    for p in range(len(row["points"])):
        own = {n: row[n][p].values.to_numpy(zero_copy_only=False) for n in row}
        whole = {n: v if n == "radii" else v.astype(np.int64) for n, v in own.items()}
        whole["points"] = whole["points"].reshape(-1, dimensions)
        yield CoverTree(**whole)


def _summed(it: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, entries, dimensions = books.shape
    sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    for batch in it:
        for k in range(batch.num_rows):
            for p, tree in enumerate(_trees(batch, k, dimensions)):
                _, more, n = assign(tree, books[p])
                sums[p] += more
                counts[p] += n
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.repeat(p, dimensions), np.repeat(e, dimensions), np.tile(np.arange(dimensions), len(p)),
                               sums[p, e].ravel(), np.repeat(counts[p, e], dimensions))],
        names=["part", "entry", "place", "total", "n"],
    )


def _coded(it: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, dimensions = books.shape
    for batch in it:
        for k in range(batch.num_rows):
            rows = batch.column(0)[k].values
            codes, error = np.zeros((len(rows), parts), np.int16), np.zeros(len(rows), np.int64)
            for p, tree in enumerate(_trees(batch, k, dimensions)):
                own, _, _ = assign(tree, books[p])
                codes[tree.order, p] = own
                error[tree.order] += ((tree.points - books[p][own]) ** 2).sum(axis=1)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([rows, lists, pa.array(error)], names=["row", "codes", "error"])


@dataclass
class Codes:
    """``codebooks[part, entry, place]`` and the table ``(key, *carried, codes, error)``."""

    codebooks: np.ndarray
    table: DataFrame

    def sha256(self) -> str:
        return sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def compress(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    carried: tuple[str, ...] = (),
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codes:
    """Codebooks of the vectors of ``df``, and the codes and squared error of each."""
    spark = df.sparkSession
    kept = df.select(
        F.struct(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)]).alias("row"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).filter(usable(F.col("vector"), parts))
    first = kept.orderBy(F.asc_nulls_last("row.id"), "vector").limit(1).collect()
    width = len(first[0]["vector"]) if first else parts
    kept = kept.filter(F.size("vector") == width)
    start = kept.orderBy(F.asc_nulls_last("row.id"), "vector").limit(entries).collect()
    books = scaled(np.array([r["vector"] for r in start]).reshape(-1, parts, width // parts), scale).transpose(1, 0, 2)
    row = kept.schema["row"].dataType.simpleString()
    ints = ", ".join(f"{n} array<array<int>>" for n in ("points", "order", *_NODES))
    blocks = stored(
        kept.mapInArrow(lambda it: _planted(it, parts, scale), f"rows array<{row}>, {ints}, radii array<array<double>>")
    )
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        found = blocks.drop("rows", "order").mapInArrow(
            lambda it, shared=shared: _summed(it, shared.value), "part long, entry long, place long, total long, n long"
        )
        books = books.copy()
        # One row per component of the codebooks.
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    shared = spark.sparkContext.broadcast(books)
    coded = blocks.mapInArrow(lambda it: _coded(it, shared.value), f"row {row}, codes array<smallint>, error long")
    named = [F.col("row.id").alias(key), *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(carried)]]
    return Codes(books, coded.select(*named, "codes", "error"))


def hexadecimal(codes: Column) -> Column:
    """The codes as text, two digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
