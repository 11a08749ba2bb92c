import numpy as np
import pytest

from declcensus.llm import language_id
from tests.llm.conftest import prose

ONE, OTHER = "ka lo mi ren tas vor", "zub xil qua jep wof hym"


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, prose(k, 40, ONE if k % 2 else OTHER), "one" if k % 2 else "other") for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return language_id.train(labelled)


def test_held_out_texts_are_told_apart(spark, model):
    rows = [(k, prose(1000 + k, 3, ONE if k % 2 else OTHER), "one" if k % 2 else "other") for k in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, truth string")
    got = language_id.identify(texts, model, carried=("truth",)).collect()
    assert np.mean([r["truth"] == r["lang_pred"] for r in got]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_slot_tells_every_language_of_an_ngram(model):
    grams, _, _ = language_id._grams([prose(7, 50, ONE), prose(8, 50, OTHER)], model.size)
    one, two = model.slots(grams)
    assert set(np.unique(model.tables[0][one] & model.tables[0][two])) <= {0, 1, 2, 3}


def test_more_than_64_languages():
    rng = np.random.default_rng(1)
    keys, owner = rng.integers(0, 1 << 63, 7000).astype(np.uint64), np.repeat(np.arange(70), 100)
    found = language_id._filter(tuple(f"l{k:02}" for k in range(70)), 4, keys, owner)
    one, two = found.slots(keys)
    assert len(found.tables) == 2
    for k in (0, 63, 64, 69):
        table = found.tables[k // 64]
        hit = (table[one] & table[two] >> np.uint64(0)) >> np.uint64(k % 64) & np.uint64(1)
        assert hit[owner == k].all() and hit[owner != k].mean() < 0.1


def test_awkward_rows(awkward, nothing, model):
    got = language_id.identify(awkward, language_id.train(awkward), carried=("doc_id", "text")).collect()
    assert len(got) == awkward.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["lang_pred"] in ("xx", "yy", "und") and (letters or r["score"] == 0)
    kept = language_id.recognised(awkward, model)
    assert kept.columns == awkward.columns and kept.count() < awkward.count()
    empty = language_id.train(nothing)
    assert language_id.identify(nothing, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward, empty).collect()} == {"und"}


def test_texts_do_not_depend_on_their_neighbours(model):
    texts = [prose(5, 3, ONE), "", None, "q", "!", prose(6, 30, OTHER)]
    together = model.judge(texts)
    assert together == tuple(sum((x for x in z), []) for z in zip(*[model.judge([t]) for t in texts], strict=True))


def plain_grams(text, size):
    """Lower-cased letters, one boundary for each run of others, in front and behind."""
    lowered = (text or "").lower()
    if not any(c.isalpha() for c in lowered):
        return []
    marked = "".join(c if c.isalpha() else " " for c in lowered)
    stream = " " + " ".join(marked.split()) + " "
    stream += " " * (size - len(stream))
    return [stream[k : k + size] for k in range(len(stream) - size + 1)]


def test_scores_are_those_of_plain_sets(spark, labelled):
    """Against sets of n-grams per language: the filter's false hits are corrected to within a little."""
    share = 0.002
    counts = {}
    for r in labelled.collect():
        own = counts.setdefault(r["lang"], {})
        for g in plain_grams(r["text"], 4):
            own[g] = own.get(g, 0) + 1
    sets = {x: {g for g, n in own.items() if n >= share * sum(own.values())} for x, own in counts.items()}
    assert all(0 < len(sets[x]) < len(counts[x]) for x in sets)
    rows = [(k, prose(500 + k, 20, ONE if k % 2 else OTHER) + (" " + prose(k, 10, "quen sar vil")) * (k % 4)) for k in range(80)]
    rows += [(100, "ka"), (101, "K a!"), (102, "日本 ka lo"), (103, "xyz" * 300)]
    model = language_id.train(labelled, share=share)
    for r in language_id.identify(spark.createDataFrame(rows, "k long, text string"), model, carried=("k", "text")).collect():
        grams = plain_grams(r["text"], 4)
        exact = {x: sum(g in own for g in grams) / len(grams) for x, own in sets.items()}
        best, second = sorted(exact.values(), reverse=True)[:2]
        assert abs(r["score"] - best) < 0.06
        if best - second > 0.06:
            assert exact[r["lang_pred"]] == best
