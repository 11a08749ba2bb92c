import random

import numpy as np
import pytest

from declcensus.llm import ngram_join as J
from tests.llm.conftest import prose


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]


def grams(text, words=3):
    own = split(text)
    return {tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()


def expected(rows, percent=90):
    """Brute force over all pairs of documents."""
    sets = [(i, grams(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, one) in enumerate(sets):
        for j, other in sets[:n]:
            if i is not None and j is not None and one and other and 100 * len(one & other) >= percent * len(one | other):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def got(df, **parameters):
    return sorted((tuple(r) for r in J.joined(df, **parameters).collect()), key=repr)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus():
    """Chains and groups of edited copies, a passage that all share, and sets about the threshold."""
    rng = random.Random(3)
    passage = prose(77, 30)
    rows = [prose(k, rng.randint(1, 90)) for k in range(60)]
    for base in range(12):
        words = prose(100 + base, 60 + 20 * base).split()
        for _ in range(8):
            words = edited(rng, words, rng.choice((0, 1, 1, 2)))
            rows.append(" ".join(words))
    rows += [passage + " " + prose(300 + k, rng.randint(0, 12)) for k in range(40)]
    rows += [f"only {k % 3}" for k in range(9)] + ["one"] * 3
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == expected(rows)
    assert got(df, percent=70) == expected(rows, 70)


def test_blocks_find_what_one_product_finds(spark, monkeypatch):
    """With small blocks, groups in several classes are dealt to many pairs of blocks."""
    rows = corpus()
    monkeypatch.setattr(J, "_BLOCK", 100)
    monkeypatch.setattr(J, "_MEMBERS", 2)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(awkward) == expected(rows)
    assert J.joined(nothing).count() == 0


def test_a_document_with_two_texts(spark):
    one, other = prose(1, 50), prose(2, 50)
    rows = [(5, one), (5, other), (1, one), (2, other), (3, prose(3, 50)), *[(7, one)] * 4]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(
        [(i, len(grams(t)), 3 if i == 3 else 1) for i, t in rows], key=repr
    )


def test_sets_are_those_of_plain_splitting():
    texts = ["A b C d", "a b c d", "", None, "x", "x y", "y x", "a b c a b c a", "\t\n", "Ä B\x0bc", "ä b c"]
    values, sizes = J.ngram_sets(texts)
    assert sizes.tolist() == [len(grams(t)) for t in texts]
    parts = [frozenset(p.tolist()) for p in np.split(values, np.cumsum(sizes)[:-1])]
    for a, one in zip(parts, texts):
        for b, other in zip(parts, texts):
            assert len(a & b) == len(grams(one) & grams(other))


@pytest.mark.parametrize("size", [1, 2, 9, 10, 11, 400])
def test_needed_is_the_least_overlap(size):
    assert J.needed(size, 90) == next(o for o in range(size + 1) if 100 * o >= 90 * size)
