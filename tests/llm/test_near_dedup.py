import itertools
import random

import numpy as np
import pytest

from declcensus.llm import batches as B
from declcensus.llm import near_dedup as N
from declcensus.llm.components import components
from tests.llm.conftest import prose


def edited(text, seed, edits):
    words, pick = text.split(), random.Random(seed)
    for _ in range(edits):
        words[pick.randrange(len(words))] = f"new{pick.randrange(10**6)}"
    return " ".join(words)


def brute_classes(rows):
    values = [(i, t, N.labelled_shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _, _ in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, s, a), (j, t, b) in itertools.combinations(values, 2):
        equal = (s or "") == (t or "") if not len(a) or not len(b) else N.aligned(a, b, 0.8) > 0
        if equal:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.fixture(scope="module")
def copies(spark):
    base = prose(1, 300)
    rows = [(k, edited(base, k, k % 14)) for k in range(120)]  # some within the threshold, some not
    rows += [(200 + k, prose(50 + k, 120)) for k in range(30)]
    rows += [(300, base), (301, base), (302, base + " " + base), (303, " ".join(reversed(base.split())))]
    return rows


def test_classes_match_brute_force(spark, copies):
    got = N.classes(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(copies)


def test_blocks_give_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "_BLOCK", 3000)
    monkeypatch.setattr(N, "_MEMBERS", 7)
    got = N.classes(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(copies)


def test_awkward_rows(awkward, nothing):
    got = N.classes(awkward).collect()
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    expected = brute_classes(rows)
    assert sorted((r["doc_id"], r["class_id"]) for r in got if r["doc_id"] is not None) == sorted((i, expected[i]) for i, _ in rows if i is not None)
    assert all(r["kept"] and r["class_id"] is None for r in got if r["doc_id"] is None)
    kept = N.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 6, 7, 8, 10, 12, 13, 13, 14]
    assert N.classes(nothing).count() == N.keep_one(nothing).count() == 0


def test_alignment_keeps_to_the_order():
    one = np.arange(100, dtype=np.uint64)
    assert N.aligned(one, one, 0.8) == 1
    assert N.aligned(one, np.roll(one, 50), 0.8) == 0
    assert N.aligned(one, np.delete(one, slice(40, 50)), 0.8) == pytest.approx(0.9)
    assert N.aligned(one[:0], one[:0], 0.8) == 1


def test_sketch_is_sensitive_to_order():
    values = B.mix(np.arange(200, dtype=np.uint64))
    same = (N.order_minhash(values) == N.order_minhash(values[::-1])).mean()
    assert same < 0.1 and (N.order_minhash(values) == N.order_minhash(values)).all()


def test_components(spark):
    pick = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)]
    links += [(pick.randrange(200, 300), pick.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    assert got == {k: v for k, v in root.items() if k in got}
    assert {k for a, b in links if a != b for k in (a, b)} == set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
