import random

import pytest

from declcensus.llm import decontamination as D
from tests.llm.conftest import prose


def distance(item: str, text: str) -> int:
    """Least edit distance of the item to any part of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        above, row = row, [k]
        for j, d in enumerate(text, 1):
            row.append(min(above[j - 1] + (c != d), above[j] + 1, row[j - 1] + 1))
    return min(row)


@pytest.mark.parametrize("seed", range(30))
def test_search_matches_the_plain_table(seed):
    pick = random.Random(seed)
    item = "".join(pick.choice("abc ") for _ in range(pick.randint(1, 90)))
    text = "".join(pick.choice("abc ") for _ in range(pick.randint(0, 200)))
    if pick.random() < 0.6:
        text += item[: len(item) // 2] + "x" + item[len(item) // 2 :]
    errors = pick.randint(0, 12)
    found, least = D.edit_search(item, text, errors), distance(item, text)
    assert (found is None) == (least > errors) and (found is None or found[0] == least)


def test_pieces_cover_the_item():
    for errors in range(12):
        parts = D.pieces("x" * 37, errors)
        assert len(parts) == errors + 1 and "".join(p for _, p in parts) == "x" * 37


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, prose(500 + k, 40)) for k in range(12)] + [(20, None), (21, ""), (22, " ?! "), (23, prose(500, 40)), (None, "gone")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_matches_match_brute_force(spark, items):
    pick, rows = random.Random(4), []
    known = [r for r in items.collect() if r["item_id"] is not None and D.normalised(r["text"])]
    for k in range(60):
        words = prose(k, 60).split()
        if k % 3:
            leak = known[k % len(known)]["text"].split()
            for _ in range(k % 7):
                leak[pick.randrange(len(leak))] = "zu"
            words[30:30] = [w.upper() for w in leak]
        rows.append((k, ",  ".join(words)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    expected = set()
    for k, text in rows:
        for r in known:
            item = D.normalised(r["text"])
            d = distance(item, D.normalised(text))
            if d <= int(len(item) * D.RATE):
                expected.add((k, r["item_id"], d))
    for block in (D.BLOCK, 300):
        got = D.matches(documents, items, block=block).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == expected
    flagged = {k for k, _, _ in expected}
    assert {r["doc_id"] for r in D.uncontaminated(documents, items, block=300).collect()} == set(range(60)) - flagged
    assert 20 < len(flagged) < 40


def test_awkward_rows(awkward, nothing, items):
    assert D.matches(awkward, items).count() == 0
    assert D.uncontaminated(awkward, items).count() == awkward.count()
    assert D.uncontaminated(awkward, items).columns == awkward.columns
    assert D.matches(nothing, items).count() == D.uncontaminated(nothing, items).count() == 0
    assert D.uncontaminated(awkward, items.limit(0)).count() == awkward.count()
    own = awkward.selectExpr("doc_id AS item_id", "text")
    found = {r["doc_id"] for r in D.matches(awkward, own).collect()}
    assert {1, 2, 8, 9, 10, 11, None} <= found and not {4, 5, 6, 7} & found
