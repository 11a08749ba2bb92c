import hashlib

import numpy as np
import pytest

from declcensus.llm import vector_codes as V

SHAPE = "vec_id long, embedding array<float>, label int, row int, codes string, `a.b` int"


def expected(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds over all vectors."""
    rows = sorted(((i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows), key=lambda r: r[0])
    cut = np.array([v for _, v in rows]).reshape(len(rows), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for k in range(rounds + 1):
        square = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        near = square.argmin(axis=2)
        if k < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = cut[near[:, p] == e, p]
                    if len(own):
                        books[p, e] = [int(x) // len(own) for x in own.sum(axis=0)]
    return books, {i: (near[n].tolist(), int(square[n].min(axis=1).sum())) for n, (i, _) in enumerate(rows)}


def vectors(count, size=64, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.5, (12, size))
    return [(int(k), (centres[rng.integers(12)] + rng.normal(0, 0.1, size)).astype(np.float32).tolist()) for k in rng.permutation(count)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, (i or 0) % 3, 1, "x", 1) for i, v in rows], SHAPE)


def check(found, wanted):
    books, codes = wanted
    assert (found.codebooks == books).all()
    assert {r["vec_id"]: (list(r["codes"]), r["error"]) for r in found.table.collect()} == codes
    assert found.sha256() == hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()


def test_matches_plain_rounds(spark):
    rows = vectors(700)
    check(V.compress(table(spark, rows).repartition(5)), expected(rows))
    check(V.compress(table(spark, rows), parts=4, entries=10, rounds=4), expected(rows, 4, 10, 4))


def test_unusable_vectors_are_left_out(spark):
    rows = vectors(90)
    bad = [(200, None), (201, [None] * 64), (202, [float("nan")] * 64), (203, [1.0] * 63 + [float("inf")]), (204, []), (205, [1.0] * 32), (206, [0.5] * 63)]
    found = V.compress(table(spark, rows + bad), carried=("label", "row", "a.b"))
    check(found, expected(rows))
    assert found.table.columns == ["vec_id", "label", "row", "a.b", "codes", "error"]


def test_few_repeated_and_huge(spark):
    few = vectors(5)
    check(V.compress(table(spark, few)), expected(few))
    same = [(k, [0.25] * 64) for k in range(100)]
    check(V.compress(table(spark, same)), expected(same))
    found = V.compress(table(spark, [*few, (None, few[0][1]), (3, few[0][1]), (6, [3e38] * 64)])).table.collect()
    assert len(found) == 8 and all(r["error"] >= 0 for r in found)


def test_nothing(spark):
    assert V.compress(table(spark, [])).table.count() == 0
    assert V.compress(table(spark, [(1, None)])).table.count() == 0


@pytest.mark.parametrize("size, spread", [(1, 5), (2, 40), (4, 3), (4, 300), (12, 50)])
def test_trees_assign_as_plain_comparison(size, spread):
    rng = np.random.default_rng(size * spread)
    points = rng.integers(-spread, spread, (1500, size))
    points[:300] = points[0]
    entries = rng.integers(-spread, spread, (64, size))
    entries[10] = entries[40]
    tree = V.cover_tree(points)
    assert (points[tree.order] == tree.points).all() and sorted(tree.order) == list(range(1500))
    for k in range(len(tree.starts)):
        own = tree.points[tree.starts[k] : tree.ends[k]]
        assert np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max() == tree.radii[k]
        heads = tree.points[tree.starts[tree.firsts[k] : tree.firsts[k] + tree.children[k]]]
        for n, head in enumerate(heads):
            assert n == 0 or np.sqrt(((heads[:n] - head) ** 2).sum(axis=1)).min() > tree.radii[k] / 2
    codes, sums, counts = V.assign(tree, entries)
    plain = ((tree.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == plain).all() and (counts == np.bincount(plain, minlength=64)).all()
    assert all((sums[e] == tree.points[plain == e].sum(axis=0)).all() for e in range(64))


def test_whole_subtrees_are_assigned():
    """Far clusters need no exact comparison."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (500, 3)) + 10_000 * k for k in range(4)])
    entries = np.array([[10_000 * k] * 3 for k in range(4)])
    tree = V.cover_tree(points)
    codes, _, counts = V.assign(tree, entries)
    assert counts.tolist() == [500] * 4 and (codes == tree.points[:, 0] // 10_000).all()
