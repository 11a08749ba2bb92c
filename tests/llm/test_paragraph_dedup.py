import itertools
from collections import defaultdict

import numpy as np
import pytest

from declcensus.llm import paragraph_dedup as P
from tests.llm.conftest import prose


def brute(rows):
    """Classes by comparing all paragraphs with each other."""
    units = []
    for i, text in rows:
        found = P.Paragraphs([text])
        for k, (a, n) in enumerate(zip(found.first.tolist(), found.words.tolist(), strict=True)):
            units.append((i, a, n, set(found.shingles(k).tolist())))
    root = list(range(len(units)))
    for x, y in itertools.combinations(range(len(units)), 2):
        both = len(units[x][3] & units[y][3])
        if both / (len(units[x][3]) + len(units[y][3]) - both) >= P.THRESHOLD:
            old, new = sorted((root[x], root[y]))[::-1]
            root = [new if r == old else r for r in root]
    members = defaultdict(list)
    for k, r in enumerate(root):
        members[r].append(units[k][:3])
    return {frozenset(m) for m in members.values() if len({i for i, _, _ in m}) > 1}


@pytest.fixture(scope="module")
def passages(spark):
    passage = prose(99, 60).split()
    rows = []
    for k in range(24):
        words = prose(k, 150).split()
        if k % 3 == 0:
            at = 20 + 5 * k
            words[at:at] = passage
        rows.append((k, " ".join(words)))
    rows += [(50, prose(3, 150)), (51, prose(200, 9) + "\n" + prose(201, 40)), (52, prose(202, 9) + "\n" + prose(203, 40))]
    return rows


def test_pasted_passages_are_found_and_others_left_alone(spark, passages):
    got = P.repeats(spark.createDataFrame(passages, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {*range(0, 24, 3), 50}
    assert all(r["removed"] == (r["doc_id"] != r["keep_doc_id"]) for r in got)
    classes = defaultdict(set)
    for r in got:
        classes[r["class_id"]].add((r["doc_id"], r["first_word"], r["words"]))
    assert {frozenset(m) for m in classes.values()} <= brute(passages)
    texts = {r["doc_id"]: r["text"] for r in P.cleaned(spark.createDataFrame(passages, "doc_id long, text string")).collect()}
    assert texts[0] == dict(passages)[0] and texts[1] == dict(passages)[1]
    assert len(texts[9].split()) <= 150 + 60 - P.REPORT_WORDS


def test_near_paragraphs_link_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "REPORT_WORDS", 1)
    lines = [prose(k, 24).split() for k in range(8)]
    rows = [(k, "\n".join(" ".join(line[k % 3 :]) for line in lines[k % 4 : k % 4 + 4])) for k in range(12)]
    for block in (1 << 20, 100):
        monkeypatch.setattr(P, "_BLOCK", block)
        got = P.repeats(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999999).collect()
        classes = defaultdict(set)
        for r in got:
            classes[r["class_id"]].add((r["doc_id"], r["first_word"], r["words"]))
        assert {frozenset(m) for m in classes.values()} == brute(rows)


def test_cuts_do_not_depend_on_what_is_around():
    passage = prose(5, 70)
    alone = P.Paragraphs([passage]).digests
    for k in range(20):
        inside = P.Paragraphs([prose(30 + k, 10 + k) + " " + passage + " " + prose(60 + k, 33)]).digests
        assert len(np.intersect1d(alone, inside)) >= 1


def test_bands():
    assert P.bands(0.8, 0.99) == 3 and P.bands(0.5, 0.99) == 7


def test_awkward_rows(awkward, nothing):
    got = P.repeats(awkward).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 8, 9}
    assert {r["doc_id"] for r in got if not r["removed"]} == {1, 8}
    clean = P.cleaned(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert P.repeats(nothing).count() == P.cleaned(nothing).count() == 0


def test_texts_do_not_depend_on_their_neighbours():
    texts = [prose(1, 90), "", None, "a b", prose(2, 25) + "\n" + prose(3, 40), prose(4, 7), "Ü_1 x\n" * 12]
    together = P.Paragraphs(texts)
    for k, text in enumerate(texts):
        alone, own = P.Paragraphs([text]), together.owner == k
        assert (alone.digests == together.digests[own]).all() and (alone.first == together.first[own]).all()
    seeds = np.arange(3, dtype=np.uint64)
    assert (np.concatenate([P.Paragraphs([t]).minima(seeds) for t in texts if len(P.Paragraphs([t]).at)], axis=1) == together.minima(seeds)).all()


def test_a_band_over_several_ranges_is_one_group(spark):
    from pyspark.sql import functions as F

    rows = spark.range(3000).select((F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id"))).alias("band"), F.col("id").alias("digest"), F.lit(9).alias("words"))
    rows = rows.unionByName(rows.filter("digest % 2 = 0"))  # found in two slices
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = P._colliding(rows).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["a"] for r in got} == {0} and sorted(r["digest"] for r in got) == [k for k in range(3000) if k % 3 < 2]


def test_bands_of_sizes_part_no_two_that_can_be_near(spark):
    words = list(range(6, 400))
    rows = spark.createDataFrame([(1, k, k) for k in words] + [(2, 5000 + k, k * k) for k in range(4, 30, 3)], "a long, digest long, words int")
    groups = {}
    for r in P._of_one_size(rows, P.THRESHOLD).collect():
        groups.setdefault((r["a"], r["size"]), set()).add(r["words"])
    sizes = {(1, k): k - P.WORDS + 1 for k in words} | {(2, k * k): k * k - P.WORDS + 1 for k in range(4, 30, 3)}
    for (a, one), x in sizes.items():
        for (b, other), y in sizes.items():
            if a == b and one < other and x >= P.THRESHOLD * y:
                assert any({one, other} <= g for (c, _), g in groups.items() if c == a)
    assert all(len(g) > 1 and min(g) - P.WORDS + 1 >= 0.6 * (max(g) - P.WORDS + 1) for g in groups.values())


def _reported(spark, rows):
    return {r["doc_id"] for r in P.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed"]}


def test_long_lines_with_a_changed_word_are_compared_as_wholes(spark):
    rows = []
    for k in range(30):
        line = prose(300 + k, 60 + k).split()
        other = [*line[: len(line) // 2], "changed", *line[len(line) // 2 + 1 :]]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, prose(400 + k, 9) + "\n" + " ".join(other))]
    shingles = [[set(zip(*(w[j:] for j in range(P.WORDS)), strict=False)) for w in (line.split() for line in t.split("\n"))] for _, t in rows]
    near = lambda x, y: len(x & y) / len(x | y) >= P.THRESHOLD
    expected = {i for i, _ in rows for j in range(i) if any(near(x, y) for x in shingles[i] for y in shingles[j])}
    got = P.repeats(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.999999).filter("removed").collect()
    assert expected == {2 * k + 1 for k in range(30)} == {r["doc_id"] for r in got}
    assert {(r["doc_id"], r["words"]) for r in got} >= {(2 * k + 1, 60 + k) for k in range(30)}


def test_every_pasted_passage_over_fifty_words_is_reported(spark):
    rows = []
    for k in range(60):
        passage = prose(500 + k, 51)
        rows += [(n, prose(1000 + n, 20 + k % 17) + " " + passage + " " + prose(2000 + n, 40)) for n in (2 * k, 2 * k + 1)]
    assert _reported(spark, rows) == {2 * k + 1 for k in range(60)}


def test_overlapping_places_are_cut_once():
    gone = [{"first_word": 1, "words": 4}, {"first_word": 1, "words": 2}, {"first_word": 4, "words": 2}]
    assert P._without("a b c d e f g", gone) == "a  g"


def test_sent_paragraphs_have_the_same_shingles():
    found = P.Paragraphs([prose(1, 90, "a b"), "ΑΣ İx É_1 σσ ΑΣ " * 9 + "\n" + prose(3, 40)])
    places = [k for k in range(len(found.at)) if not found.exact[k]]
    for k, sent in zip(places, P._shingles([found.plain(k) for k in places]), strict=True):
        assert (sent == found.shingles(k)).all()


def test_few_paragraphs_are_linked_as_many_are():
    rng = np.random.default_rng(5)
    for n in range(200):
        base = P.B.labelled(rng.integers(0, 1 << 60, 40).astype(np.uint64))
        held = []
        for k in range(rng.integers(1, P._FEW + 1)):
            own = base.copy() if rng.random() < 0.8 else rng.integers(0, 1 << 60, 40).astype(np.uint64)
            own[rng.integers(0, 40, rng.integers(0, 8))] = rng.integers(0, 1 << 60)
            held.append((k, k, int(rng.integers(0, 2)), np.unique(own)))
        for key in ((1, 0, 0), (1, 0, 1)):
            groups = []
            for find in (P._pairs, P.links_between):
                root = list(range(len(held)))
                for a, b in find(key, held, P.THRESHOLD):
                    root = [root[b] if r == root[a] else r for r in root]
                groups.append([[root[x] == root[y] for x in range(len(held))] for y in range(len(held))])
            assert groups[0] == groups[1]


def test_bands_are_made_once_and_a_hot_one_is_spread(spark):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def counted(it):
        for batch in it:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(3000).select((F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id"))).alias("band"), F.col("id").alias("digest"), F.lit(9).alias("words"))
    expected = {(0, k) for k in range(3000) if k % 3 < 2}
    for sampled in (rows.sample(0.2, seed=1), rows.limit(0)):  # the second knows of no hot band
        made.value = 0
        got = P._colliding(rows.mapInArrow(counted, rows.schema), sampled).collect()
        assert {(r["a"], r["digest"]) for r in got} == expected and made.value == 3000
    assert P._hot(rows.sample(0.2, seed=1)) == [7] and P._hot(rows.limit(0)) == []


def test_winnowed_places_are_those_of_all_windows():
    rng = np.random.default_rng(2)
    for n, window, most in ((40, 24, 1 << 60), (300, 24, 3), (500, 32, 9), (500, 32, 1 << 60), (60, 5, 1), (7, 7, 2)):
        values = rng.integers(0, most, n).astype(np.uint64)
        windows = np.lib.stride_tricks.sliding_window_view(values, window)
        within = rng.random(len(windows)) < 0.8
        expected = np.unique((np.arange(len(windows)) + windows.argmin(axis=1))[within])
        assert P.B.winnowed(values, window, within).tolist() == expected.tolist()


def test_groups_of_few_paragraphs_are_compared_together_as_apart():
    rng = np.random.default_rng(6)
    blocks = []
    for n in range(150):
        base = P.B.labelled(rng.integers(0, 1 << 60, 30).astype(np.uint64))
        held = []
        for k in range(rng.integers(1, P._FEW + 1)):
            own = np.roll(base, rng.integers(0, 30) if rng.random() < 0.2 else 0)
            own[rng.integers(0, 30, rng.integers(0, 6))] += np.uint64(k + 1)
            held.append((10 * n + k, k, int(rng.integers(0, 2)), own[: rng.integers(20, 31)]))
        blocks.append(((n, 0, int(rng.integers(0, 2))), held))
    able = [(x, y) for _, held in blocks for y in held for x in held if x[0] < y[0]]
    got = P._all_aligned([x[3] for x, _ in able], [y[3] for _, y in able], P.THRESHOLD)
    assert got.tolist() == [bool(P.aligned(x[3], y[3], P.THRESHOLD)) for x, y in able] and 0 < got.sum() < len(got)
    assert P._all_pairs(blocks, P.THRESHOLD) == [link for key, held in blocks for link in P._pairs(key, held, P.THRESHOLD)]
